"""Tables whose other columns have the names that operators use inside; later mentions of replaced names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from survkit.llm import align, common, decontam, jaccard, langid, lm, packing, phrases, pii, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ["_id", "_th", "_h", "y", "x", "__id", "__th", "__h", "__maybe", "__new", "__kinds", "__s", "__k", "__spans", "sealed", "c0", "kinds", "n_entities", "score", "toxicity", "key", "block", "train", "shard", "id", "spans", "words", "th", "n_words"]
ITEM = " ".join(f"k{i}" for i in range(15))
ROWS = [(1, f"{ITEM} mail a.b@c.org", "en"), (2, "Mary Fairfax token=abcdef12", "en"), (2, "Mary Fairfax token=abcdef12", "en"), (None, None, None), (4, "", "de"), (5, " ".join(f"w{i}" for i in range(40)), "en"), (6, " ".join(f"w{i}" for i in range(40)) + " more", "fr")]


def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def clashing(spark):
    d = plain(spark)
    for i, c in enumerate(CLASHES):
        d = d.withColumn(c, F.lit(f"kept {i}"))
    return d


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


#: Each operator or stage as a function of documents; those of the first table return all columns of documents.
WHOLE = {
    "toxicity.score": lambda s, d: toxicity.score(d, ({}, 0.0), "new score"),
    "decontam.remove": lambda s, d: decontam.remove(d, _bench(s)),
    "decontam.remove spans": lambda s, d: decontam.remove(d, _bench(s), mode="spans"),
    "jaccard.keep_one": lambda s, d: jaccard.keep_one(d),
    "pii.replace": lambda s, d: pii.replace(d, "key"),
    **{f"stage {name}": lambda s, d, f=f: f(s, d, SF) for name, f in corpus_pipeline.STAGES[:4]},
}
OWN = {
    "toxicity.train": lambda s, d: str(toxicity.train(d, _labels(s), F.lit(True))),
    "quality.train": lambda s, d: str(quality.train(d, _labels(s), F.lit(True))),
    "decontam.contamination": lambda s, d: decontam.contamination(d, _bench(s)),
    "jaccard.near_duplicates": lambda s, d: jaccard.near_duplicates(d),
    "lm.score": lambda s, d: lm.score(d, F.lit(False)).drop("score", "base_score"),
    "packing": lambda s, d: packing.pack_documents(d),
    "secrets.find": lambda s, d: secrets.find(d),
    "align.linked": lambda s, d: align.linked(d),
    "phrases": lambda s, d: phrases.frequent_phrases(d, threshold=2, shards=2)[0],
    "stage packing": lambda s, d: corpus_pipeline.pack(s, d, SF),
}


def rows(df):
    return df if isinstance(df, str) else sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", WHOLE)
def test_other_columns_pass_through(spark, clashing, name):
    out = WHOLE[name](spark, clashing)
    base = WHOLE[name](spark, plain(spark))
    assert out.columns[: len(clashing.columns)] == clashing.columns
    own = [c for c in base.columns if c not in CLASHES]
    assert rows(out.select(*own)) == rows(base.select(*own))
    for r in out.collect():
        assert all(r[c] == f"kept {i}" for i, c in enumerate(CLASHES))


@pytest.mark.parametrize("name", OWN)
def test_other_columns_change_nothing(spark, clashing, name):
    assert rows(OWN[name](spark, clashing)) == rows(OWN[name](spark, plain(spark)))


@pytest.mark.parametrize("name", [*WHOLE, *OWN])
def test_empty_tables(spark, name):
    out = (WHOLE | OWN)[name](spark, plain(spark).limit(0))
    assert isinstance(out, str) or out.collect() == []


def test_free_name():
    assert common.free_name(["a", "_B"], "b") == "b" and common.free_name(["B", "_b"], "b") == "__b"


def text(spark, t):
    return pii.replace(spark.createDataFrame([(1, t)], "doc_id long, text string"), "key").first()["text"]


def test_later_mentions_follow_the_name(spark):
    got = text(spark, "Mary Fairfax met John Fairfax. Fairfax said hello. Mr. Fairfax left. Fairfaxes stay; Mary waved.")
    new = got.split()[1]
    given = got.split()[0]
    assert new != "Fairfax" and given != "Mary"
    assert got == f"{given} {new} met John {new}. {new} said hello. Mr. {new} left. Fairfaxes stay; {given} waved."
    got = text(spark, "Dr. Alice Fairfax and Alice Fairfax came; Alice said yes.")
    assert got == f"Dr. A. {new} and A. {new} came; A. said yes."
    assert text(spark, "Fairfax alone is no name here.") == "Fairfax alone is no name here."


def test_surrogates_need_a_key(spark):
    with pytest.raises(ValueError):
        pii.replace(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
