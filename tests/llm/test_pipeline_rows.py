"""What each stage of the pipeline keeps of planted rows."""

import random
from collections import Counter

import pytest

SF = "/root/testdata/sf0.01"
FIRST = 10_000_000
#: Names that the operators use themselves.
CLASHING = ["toxic", "score", "rid", "node", "root", "h", "n", "id", "copies", "size", "spans", "__bad", "__id"]


def prose(rng, n):
    return ["".join(rng.choice("klmnprtv") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def stages(spark):
    """(documents, those that stay after each stage)."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(4)
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=lambda t: len(t.split()))
    toxic, body, lone, long = prose(rng, 60), prose(rng, 300), prose(rng, 80), prose(rng, 60_000)
    toxic[10:40:10] = ["idiot", "worthless", "scum"]
    near = list(body)
    near[150] = "changed"
    texts = {
        "toxic": " ".join(toxic),
        "quoted": " ".join(f'"{w}"' if w in ("idiot", "worthless", "scum") else w for w in prose(rng, 20) + toxic),
        "null": None,
        "empty": "",
        "first": " ".join(body),
        "copy": " ".join(body),
        "near": " ".join(near),
        "benchmark": " ".join(prose(rng, 30) + item.split() + prose(rng, 30)),
        "mail": " ".join(prose(rng, 30) + ["write to some.body@example.org now"]),
        "long": " ".join(long),
        "nulls": " ".join(lone),
    }
    ids = {name: FIRST + k for k, name in enumerate(texts)}
    rows = [(ids[k], t, *((None,) * 3 if k == "nulls" else ("en", "hot", len(t or "")))) for k, t in texts.items()]
    repeated = (FIRST + 100, " ".join(prose(rng, 50)), "en", "hot", 299)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")  # the planted ones alone are empty
    docs = docs.union(spark.createDataFrame([*rows, repeated, repeated], docs.schema))
    docs = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).checkpoint())
    return ids, out


def planted(df):
    return Counter(r["doc_id"] for r in df.where(f"doc_id >= {FIRST}").select("doc_id").collect())


def test_columns_stay(stages):
    _, out = stages
    assert all(df.columns == out[0].columns for df in out[:-1])
    assert set(out[-1].columns) == set(out[0].columns)  # copies takes the place of the column of that name


def test_toxic_documents_go_and_quoted_ones_stay(stages):
    ids, out = stages
    assert planted(out[0]) - planted(out[1]) == {ids["toxic"]: 1}


def test_one_of_each_group_stays(stages):
    ids, out = stages
    gone = planted(out[1]) - planted(out[2])
    gone.pop(FIRST + 100, None)
    assert gone == {ids["empty"]: 1, ids["copy"]: 1, ids["near"]: 1}  # null is empty, and comes first
    assert planted(out[2])[FIRST + 100] == 1


def test_benchmark_passages_go(stages):
    ids, out = stages
    assert planted(out[2]) - planted(out[3]) == {ids["benchmark"]: 1}


def test_personal_data_goes_and_all_rows_stay(stages):
    ids, out = stages
    assert out[3].count() == out[4].count() and planted(out[3]) == planted(out[4])
    before, after = ({r["doc_id"]: r for r in df.where(f"doc_id >= {FIRST}").collect()} for df in out[3:5])
    assert "@" not in after[ids["mail"]]["text"] and after[ids["mail"]]["text"].startswith(before[ids["mail"]]["text"][:100])
    assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
    assert after[ids["long"]]["text"] == before[ids["long"]]["text"] and not after[ids["null"]]["text"]
    assert after[ids["nulls"]]["lang"] is None and after[ids["nulls"]]["source"] is None


def test_the_mix_takes_rows_of_its_input(spark, stages):
    import corpus_pipeline

    _, out = stages
    rows = {(r["doc_id"], r["text"]): r["copies"] for r in out[5].collect()}
    assert rows and set(rows) <= {(r["doc_id"], r["text"]) for r in out[4].collect()} and set(rows.values()) <= {1, 2, 3}
    again = corpus_pipeline.mix_sources(spark, out[4].repartition(3), SF)
    assert {(r["doc_id"], r["text"]): r["copies"] for r in again.collect()} == rows
