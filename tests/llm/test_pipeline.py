"""The pipeline stage by stage, and the registered queries."""

import importlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quantloom.llm import langid
from quantloom.llm import queries as Q
from quantloom.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    ws, docs = Workspace(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, f in P.STAGES:
        docs = ws.save(f(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def test_columns(stages):
    for name in ("language_id", "near_dedup", "pseudonyms", "mix"):
        assert stages[name].columns == stages["input"].columns


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages["input"].count(), stages["language_id"].count()
    assert before - after == stages["input"].where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").count()


def test_one_of_each_group_stays(stages):
    shingle = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    before = {r.doc_id: shingle(r.text) for r in stages["language_id"].collect()}
    after = {r.doc_id for r in stages["near_dedup"].collect()}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(after)
    assert not any(near(before[a], before[b]) for i, a in enumerate(kept) for b in kept[:i])
    for d in set(before) - after:
        assert any(near(before[d], before[o]) for o in before if o != d)


def test_pseudonyms_change_only_texts_with_data(stages):
    import re

    old = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    for r in stages["pseudonyms"].collect():
        if r.text != old[r.doc_id]:
            assert re.search(r"\d\d|@|=", old[r.doc_id])
        for found in re.findall(r"\S+@mail\d+\.example\.com|AKIA\w{16}|\+1 \(\d{3}\) \d{3}-\d{4}", old[r.doc_id]):
            assert found not in r.text


def test_mix_takes_most_words_once(stages):
    before, after = stages["pseudonyms"].collect(), stages["mix"].collect()
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) / words(before) - 0.9) < 0.02 and len({r.doc_id for r in after}) == len(after)


def test_pieces_cover_all_documents(stages):
    pieces = stages["pack"].collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert set(total) == {r.doc_id for r in stages["mix"].collect()} and all(total[p.doc_id] == p.doc_tokens for p in pieces)


# --- hard cases of every stage --------------------------------------------------------------

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_pseudonyms int, rank int, taken long, row string, r1 long, size int"


def hard_rows():
    rng = np.random.default_rng(9)
    syl = {"en": ["the", "ring", "on", "ter"], "de": ["sch", "ung", "ei", "der"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syl[lang], 2)) + "".join(rng.choice(list("abcdefgh"), 2)) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(12, 80))), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(None, text("en", 30), "en", "s0") for _ in range(4)]  # no id
    rows += [(5, text("de", 40), "de", "s1"), (7, text("en", 25), "en", None)]  # an id with a second text
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[0][1] + " more", "en", "s9"), (None, rows[0][1], "en", "s0")]  # copies, one without an id
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(110, None, "en", "s0"), (111, "", "de", "s0"), (112, " \n", None, None), (113, "!!! 123", "en", "s0"), (114, text("en", 150_000), "en", "s2"), (115, "mail a.b@mail9.example.com or +1 (632) 555-4827 " + text("en", 30), "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 3, 1, 2, "row", 4, 5) for r in rows]


def hard(spark, parts=3):
    return spark.createDataFrame(hard_rows(), EXTRA).repartition(parts)


SORT = lambda rows: sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_hard_tables(spark, name):
    stage, docs = dict(P.STAGES)[name], hard(spark)
    got = stage(spark, docs, SF)
    rows = SORT(got.collect())
    for parts in (1, 7):
        assert SORT(stage(spark, hard(spark, parts), SF).collect()) == rows
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns
    if name != "pack":
        assert got.columns == docs.columns
    if name not in ("pack", "pseudonyms"):
        assert not Counter(rows) - Counter(map(tuple, docs.collect()))  # rows come through as they are
    texts = {r[:2] for r in rows}
    if name == "language_id":
        assert len(rows) == len(hard_rows()) - 4 and sum(r[0] is None for r in rows) == 5
    if name == "near_dedup":
        assert sum(r[0] == 5 for r in rows) == 2 and sum(r[0] == 7 for r in rows) == 2 and sum(r[0] is None for r in rows) == 4
        assert not {100, 101} & {r[0] for r in rows} and len({r[1] for r in rows}) == len(rows) and sum(r[0] == 3 for r in rows) == 1
    if name == "pseudonyms":
        assert len(rows) == len(hard_rows()) and Counter(r[2:4] + r[5:] for r in rows) == Counter(r[2:4] + r[5:] for r in hard_rows())
        (mail,) = [r for r in rows if r[0] == 115]
        assert "a.b@" not in mail[1] and "4827" not in mail[1] and mail[4] == len(mail[1]) and mail[6] == 3
        assert sum((r[0], r[1]) in texts for r in hard_rows()) == len(hard_rows()) - 1
    if name == "mix":  # one text holds nearly all words; all sources but its own are taken whole
        assert {r[0] for r in rows} >= {r[0] for r in hard_rows() if r[1] and r[1].split() and r[3] != "s2"} and not {110, 111, 112} & {r[0] for r in rows}
    if name == "pack":
        assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter(r[0] for r in hard_rows())


def test_targets_of_many_sources(spark):
    from quantloom.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 23}" if i % 5 else None) for i in range(300)], "doc_id long, text string, source string")
    near = lambda df: sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())
    assert near(mixing.mix_sources(docs)) == near(mixing.mix_sources(docs, driver_sources=3, broadcast_counts=1))


def test_languages_in_several_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, use=F.col("doc_id").isNotNull())
    one, several = ({r.doc_id: r for r in langid.identify(docs, model, **x).collect()} for x in ({}, {"at_once": 1}))
    assert len(model.langs) > 2 and one.keys() == several.keys()
    assert all((r.lang_pred, r.rejected) == (several[i].lang_pred, several[i].rejected) and abs(r.score - several[i].score) < 1e-5 for i, r in one.items())
    with pytest.raises(ValueError):
        langid.identify(docs.withColumn("score", F.lit(1)), model)


def test_language_scores_by_plain_cosine(spark):
    """Scores from the stored centroids with plain Python sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, use=F.col("doc_id").isNotNull())
    cents = [(r.lang, np.frombuffer(r.vector, np.float32)) for r in model.table.collect()]
    for r in langid.identify(docs.orderBy("doc_id").limit(12), model).collect():
        counts = Counter()
        data = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in (r.text or "").lower()).encode()
        for size in (1, 2, 3):
            for i in range(len(data) - size + 1):
                g = data[i : i + size]
                if b"  " in g or g == b" ":
                    continue
                code = (int.from_bytes(g, "big") + size * 0x85EBCA6B & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
                counts[code >> 20] += 1
        x = np.zeros(langid.DIMS)
        for k, n in counts.items():
            x[k] = np.log1p(n) * model.idf[k]
        x /= np.sqrt((x * x).sum()) or 1
        best = max(cents, key=lambda c: float(c[1] @ x))
        assert r.lang_pred == "und" or (r.lang_pred == best[0] and abs(r.score - float(best[1] @ x)) < 1e-4)


def test_hot_groups_are_dealt_by_their_parts(spark):
    from quantloom.llm.ranking import rank_within

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).select("id", (F.col("id") % 3).alias("k"))
        n = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        ranked = rank_within(df.join(n, "k"), ["k"], "n", [F.xxhash64("id"), F.col("id")], split_rows=100)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Exchange hashpartitioning\(k#\d+L?, _part#\d+, \d+\), REPARTITION_BY_COL", plan)
        for k in range(3):
            assert sorted(r["rank"] for r in ranked.where(f"k = {k}").collect()) == list(range(1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 14)} and set(Q.queries()) | {"pipeline"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
