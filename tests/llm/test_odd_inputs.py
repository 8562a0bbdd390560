"""Names that clash with the operators' own, null ids in numbers, short lines."""

import pytest

from pyspark.sql import functions as F

from stackscope.llm import decontaminate, lines, minhash, quality

CLASHES = ["_i", "_gone", "_again", "_bad", "id", "n", "k", "t", "th", "rank", "own", "gone", "again", "bad", "gone_", "key", "kept", "c", "_Gone"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(40))) for i in range(20)] + [(None, "a b c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES:
        if name.lower() not in {c.lower() for c in df.columns}:
            df = df.withColumn(name, F.lit("x"))
    return df


def test_clashing_names(spark, clashing):
    kept = minhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.text) == list(range(7))
    bench = spark.createDataFrame([("b", " ".join(f"w5x{j}" for j in range(20)))], "item_id string, text string")
    clean = decontaminate.clean(clashing, bench)
    assert clean.columns == clashing.columns
    assert {r.doc_id for r in clashing.collect()} - {r.doc_id for r in clean.collect()} == {5, 12, 19}
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert quality.resample(clashing, labels.withColumn("id", F.lit(1)), share=0.5).where("kept").count() in (11, 12)
    assert lines.dedup(clashing).count() == 22


def test_null_ids_are_no_group(spark):
    """Rows without an id have places of their own after all ids: repeats among them go, equal texts stay alike."""
    line = " ".join(f"s{i}" for i in range(20))
    rows = [(None, f"own{k} words of this row\n{line}") for k in range(30)] + [(None, "twin text of ten words that stands here two times")] * 2
    rows += [(1, "first of all\n" + line)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(line in (r.text or "") for r in got) == 1 and [r.text for r in got if r.doc_id == 1] == [rows[-1][1]]
    assert sum(r.text.startswith("twin") for r in got) == 2
    # without the row that has an id, one of the others keeps the line
    got = lines.dedup(spark.createDataFrame(rows[:-1], "doc_id long, text string")).collect()
    assert sum(line in r.text for r in got) == 1
    ranked = spark.createDataFrame([(None, r[1], 5) for r in rows], "doc_id long, text string, rank long")
    got = lines.dedup(ranked, rank_col="rank").collect()
    assert sum(line in r.text for r in got) == 1 and all(r.doc_id is None for r in got)


def test_short_lines_stay(spark):
    long = " ".join(f"s{i}" for i in range(20))
    rows = [(k, f"In.\nown line {k} of words\nfour words stand here\n{long}\nLe.") for k in range(6)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_line_words=6).collect()
    for r in got:
        want = rows[r.doc_id][1]
        assert r.text == (want if r.doc_id == 0 else want.replace(long + "\n", ""))
    again = lines.dedup(spark.createDataFrame([(1, "In.\nIn.\n" + long + "\n" + long)], "doc_id long, text string"), min_line_words=6)
    assert again.first().text == "In.\nIn.\n" + long + "\n"
