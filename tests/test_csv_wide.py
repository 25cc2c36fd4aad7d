"""Wide CSV files of more columns than a plan or a parser takes, with gaps and quoted names."""

from corvane.sources import files


def test_more_names_than_a_parser_has_columns(spark, tmp_path):
    names = [f"T{i}" for i in range(21_000)]
    (tmp_path / "prices.csv").write_text("\n".join([",".join(["date", *names]), ",".join(["2020-01-01", *("1.5" for _ in names)]), ",".join(["2020-01-02", "", "nan", *("2" for _ in names[2:])])]) + "\n")
    (tmp_path / "benchmarks.csv").write_text("date,SPX\n2020-01-01,7\n")
    (tmp_path / "fundamentals.csv").write_text("date,ticker,pe\n2020-01-01,T5,3\n2020-01-01,X,3\n")
    (tmp_path / "meta.csv").write_text("ticker,name,sector,themes,pays_dividend\n" + "".join(f"{n},n,s,a|b,1\n" for n in names))
    got = files.csv_dataset(spark, str(tmp_path))
    assert got["prices"].count() == 2 * 21_000 - 2
    assert [r.pe for r in got["fundamentals"].collect()] == [3.0] and got["benchmarks"].first().level == 7.0


def test_wide_files_keep_gaps_and_quoted_names(spark, tmp_path):
    rows = {("2020-01-01", "A", 1.0), ("2020-01-01", 'B,"b"', 2.0), ("2020-01-02", "D\\d", 3.0), ("2020-01-03", "A", 4.0), ("2020-01-03", "C", None), ("2020-01-03", "D\\d", 1e-9)}
    df = spark.createDataFrame(sorted(rows, key=str), "date string, ticker string, close double")
    files.write_wide(df, "ticker", "close", str(tmp_path / "w.csv"))
    back = files.wide_rows(spark, str(tmp_path / "w.csv")).where("cell <> '' and name <> 'date'").collect()
    assert {(r.date, r.name, float(r.cell)) for r in back} == {r for r in rows if r[2] is not None}
    plain = spark.read.csv(str(tmp_path / "w.csv"), header=True)  # another reader sees the same table
    assert sorted(plain.columns) == sorted(["date", "A", 'B,"b"', "C", "D\\d"]) and plain.count() == 3
    assert {(r.date, r["D\\d"]) for r in plain.collect()} == {("2020-01-01", None), ("2020-01-02", "3.0"), ("2020-01-03", "1.0E-9")}
