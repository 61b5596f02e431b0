"""Alignment, collocations and decontamination against brute force; the hard rows of the mended operators."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import alignment, collocations, contamination, fingerprints, langid, mixing, neighbours, ranking, urls
from tests.llm.test_operators import SCHEMA, make_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3).cache()


# --- 11: alignment --------------------------------------------------------------------------

ODD = [
    "plain words here", " leading and  double  blanks ", "", None, " ", "   ", "\n\n tabs\tand\nlines \n", "trailing ", "a", "<|endoftext|> <s> </s> <unk> <0x41> special", "x▁y ▁ z", "日本語の文 と 空白", "é à ç ü à  è", "nbsp\u00a0 here \u00a0 \u00a0x", "\u3000 wide \u2009thin \u2028line \u0085next",
    "emoji 👩‍👩‍👧 and ﬁ ligature ½", "x" * 3000, "don't can't we'll I'M 'tis", "1234 5,678.90 -- $%^&*()", "\x00\x01 control \x1c\x1f chars", "same text twice", "same text twice", "mixed\r\nline ends \r\n x", " a", "a ", "  a  b", "\t", "ends with nbsp\u00a0", "a \u2581b c\u2581 d",
]


def plain_alignment(pair, texts):
    """The contract, word by word, over whole texts."""
    out, holders = [], Counter()
    for t in texts:
        got = None
        if t:
            whole = " " + t
            a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(t)
            x, y = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
            if b"".join(x) == whole.encode() == b"".join(y):
                ends = sorted(set(np.cumsum([len(v) for v in x]).tolist()) & set(np.cumsum([len(v) for v in y]).tolist()))
                place = lambda parts: np.searchsorted(ends, np.cumsum([len(v) for v in parts]))
                groups = [([], []) for _ in ends]
                for ids, side, at in ((a, 0, place(x)), (b, 1, place(y))):
                    for i, g in zip(ids, at.tolist()):
                        groups[g][side].append(i)
                links = [(p, q) for g in groups for p in g[0] for q in g[1]]
                holders.update(set(links))
                got = (a, b, groups, links)
        out.append(got)
    best = defaultdict(int)
    for (p, _), n in holders.items():
        best[p] = max(best[p], n)
    rows = []
    for got in out:
        if got is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = got
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows, holders


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 2000])
def test_alignment(spark, files, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    texts = ODD + [r[1] for r in make_docs()]
    ids = [None if i == 5 else i % 40 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "b", 2.0) for i, t in zip(ids, texts)], "doc_id long, text string, block long, segment string, pair double").repartition(3)
    rows, table = alignment.align_documents(df, *files)
    want, holders = plain_alignment(alignment.pair(*files), texts)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, rows.collect())) == sorted(key((i, *r)) for i, r in zip(ids, want))
    assert {(r["a"], r["b"]): r["docs"] for r in table.collect()} == dict(holders)


def test_alignment_with_salted_pairs_and_of_nothing(spark, files, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    want = sorted(alignment.align_documents(df, *files)[0].collect())
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert sorted(alignment.align_documents(df, *files)[0].collect()) == want
    assert alignment.align_documents(df.where("false"), *files)[0].collect() == []
    only = alignment.align_documents(df.where("text IS NULL OR text = ''"), *files)[0].collect()
    assert [tuple(r)[1:] for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_texts_are_cut_only_where_no_token_crosses(files):
    pair = alignment.pair(*files)
    assert pair.splits
    assert alignment._crosses(b"a b") and alignment._crosses("é ".encode()) and not alignment._crosses("\u00a0 ".encode()) and not alignment._crosses(b"  x")
    for t in filter(None, ODD):
        raw = np.frombuffer((" " + t).encode(), np.uint8)
        cuts = [*alignment._starts(np.array([0, len(raw)]), raw).tolist(), len(raw)]
        parts = [raw[x:y].tobytes().decode() for x, y in zip(cuts, cuts[1:])]
        assert sum([pair.a.encode(p, add_special_tokens=False).ids for p in parts], []) == pair.a.encode(" " + t, add_special_tokens=False).ids
        assert sum([pair.b.encode(p[1:]) for p in parts], []) == pair.b.encode(t)


def test_packed_codes():
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.integers(0, 2**k, 200) for k in (1, 7, 8, 14, 15, 21, 28)])
    edge = np.array([0, 0, 5, 700, 700, len(codes)])
    got, at = alignment.unpacked(alignment.packed(codes, edge))
    assert got.tolist() == codes.tolist() and at.tolist() == edge.tolist()
    assert [x.tolist() for x in alignment.unpacked([])] == [[], [0]]


# --- 12: collocations -----------------------------------------------------------------------


def plain_collocations(rows, least, top):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = {q for p, a in some.items() if len(p) > 3 for q in ((p[0], *p[1:-1]), (p[0], *p[2:])) if some[q] == a}
    out = []
    for p, a in some.items():
        if p in held:
            continue
        lang, w = p[0], p[1:]
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def phrases(spark):
    rng = np.random.default_rng(3)
    vocab = ["alpha", "Beta", "gamma", "DELTA", "été", "x", "日本", "new york", "in spite of", "a a a"]
    rows = []
    for i in range(120):
        words = [vocab[j] for j in rng.integers(0, len(vocab), rng.integers(0, 60))]
        rows.append((" ".join(w + str(rng.choice(["", "", "", ",", ".", "\n", " \t", "!"])) for w in words), (None, "en", "fr", "en")[i % 4], i, "s", 0))
    rows += [(None, "en", 1, "s", 0), ("", None, 2, "s", 0), (" .,; ", "xx", 3, "s", 0), ("alpha", "only", None, "s", 0), ("one two three four five six " * 400, "long", 9, "s", 0), *rows[:7]]
    return rows


@pytest.mark.parametrize(("slots", "coded"), [(collocations.SLOTS, collocations.CODED), (40, 5), (2_000_000, 0)])
def test_collocations(spark, phrases, monkeypatch, slots, coded):
    monkeypatch.setattr(collocations, "SLOTS", slots)
    monkeypatch.setattr(collocations, "CODED", coded)
    monkeypatch.setattr(collocations, "ROW_SLOTS", 16)
    df = spark.createDataFrame(phrases, "text string, lang string, doc_id long, phrase string, one int").repartition(5)
    got = collocations.collocations(df, least=8, top=50)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r[0], r[1]) for r in phrases], 8, 50)


def test_collocations_of_nothing(spark, phrases):
    df = spark.createDataFrame(phrases, "text string, lang string, doc_id long, phrase string, one int")
    assert collocations.collocations(df.where("false")).collect() == []
    assert collocations.collocations(df, least=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 3 * 10**12, 4 * 10**12, 5 * 10**12, 9 * 10**13
    row = {"lang": "en", "phrase": "a b", "k": 2, "a": a, "n": n, "one": 1, "two": 2} | {f"{s}{j}": None for s in "lr" for j in range(1, 5)} | {"l1": l, "r1": r}
    schema = ", ".join(f"{k} {'string' if k in ('lang', 'phrase') else 'int' if k == 'k' else 'long'}" for k in row)
    got = collocations.scored(spark.createDataFrame([tuple(row.values())], schema), 100).first()
    assert got["score"] == 1000 * a * n // (l * r) and (got["l"], got["r"]) == (l, r)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_the_hash_is_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    one, two = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    one[: n // 2] = one[0] if n else 0  # keys that differ in their second number only
    table = collocations.PerfectHash(one, two)
    assert sorted(table.find(one, two).tolist()) == list(range(n))
    assert (table.find(one, two + np.uint64(1)) == -1).all()


# --- 13: decontamination --------------------------------------------------------------------


def plain_hits(docs, items, n=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - n + 1) if w else 0):
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= own
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def passages():
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "Ωmega", "x"]
    text = lambda k: " ".join(rng.choice(vocab, k))
    items = [(10, text(30)), (9, text(12)), (100, text(10)), (3, text(4)), (2, "w1 w2"), (2, text(15)), (7, None), (8, ""), (11, "..."), (None, text(20)), (12, text(25))]
    texts = {i: t for i, t in items if t}
    docs = [text(200), texts[10], texts[10].upper().replace(" ", ", "), f"{text(40)} {texts[9]} {text(300)} {texts[12]}", " ".join(texts[10].split()[5:16]), " ".join(texts[10].split()[5:14]), None, "", "w1", "w1 w2", "w1-w2_w1", f"{texts[100]} {texts[100]}",
            " ".join([texts[12]] * 40), text(5000), f"{text(120)} {texts[10]}", "w1\x00w2 \x7f w1"]
    docs += [docs[3]] * 30
    return items, [(None if i == 4 else i % 20, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 200}])
@pytest.mark.parametrize(("piece", "symbols"), [(128, 1 << 20), (16, 300)])
def test_decontamination(spark, monkeypatch, options, piece, symbols):
    monkeypatch.setattr(contamination, "PIECE", piece)
    monkeypatch.setattr(contamination, "INDEX_SYMBOLS", symbols)
    items, docs = passages()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, spans string, row int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.benchmark_spans(df, bench, **options).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["n_hit"] > 0) for r in rows]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, plain_hits(docs, items)))
    texts = {i: t for i, t in docs if i is not None}
    for r in rows:  # spans are whole words, apart from each other, and hold what was hit
        t = (texts.get(r["doc_id"]) or "").encode() if r["doc_id"] is not None else b""
        if t and len([1 for i, _ in docs if i == r["doc_id"]]) == 1:
            inside = [x for s in r["spans"] for x in plain_hits([(0, t[s["begin"] : s["end"]].decode())], [])]
            assert sum(x[1] for x in inside) == r["n_hit"]
            assert all(p["end"] < q["begin"] for p, q in zip(r["spans"], r["spans"][1:]))


def test_decontamination_of_and_by_nothing(spark):
    items, docs = passages()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination.benchmark_spans(df.where("false"), bench).collect() == []
    assert {(r["n_hit"], len(r["item_ids"])) for r in contamination.benchmark_spans(df, bench.where("false")).collect()} == {(0, 0)}


def test_index_against_every_position():
    rng = np.random.default_rng(1)
    for _ in range(150):
        most, n = int(rng.integers(1, 7)), int(rng.integers(1, 80))
        s = rng.integers(0, most + 1, n)
        s[-1] = 0
        ends = np.flatnonzero(s == 0)
        key = lambda i: (s[i : ends[np.searchsorted(ends, i)]].tolist(), ends[np.searchsorted(ends, i)])  # noqa: E731, B023
        assert contamination.sort_suffixes(s).tolist() == sorted(range(n), key=lambda i: (key(i)[0] + [0], key(i)[1]))  # noqa: B023
        index = contamination.FmIndex(s, most)
        for _ in range(4):
            p = rng.integers(1, most + 1, int(rng.integers(1, 5)))
            low, high = index.search(np.array([p]))
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(n - len(p) + 1) if (s[i : i + len(p)] == p).all()]


# --- the registered functions ---------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    items, more = passages()
    rows = [(i, t, ("en", "fr", None)[(i or 0) % 3], "s", 0) for i, t in [*more, *((r[0] + 100, r[1]) for r in make_docs())]]
    rows += [(500 + i, "of the in spite of the of the", "en", "s", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_op11(spark, folder, files):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = plain_alignment(alignment.pair(*files), [r["text"] for r in rows])[0]
    got = alignment.op11_tokenizer_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(key((r["doc_id"], *w)) for r, w in zip(rows, want))


def test_op12(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()
    got = sorted(map(tuple, collocations.op12_collocations(spark, folder).collect()))
    assert got == plain_collocations([tuple(r) for r in rows], 100, 2000) and got


def test_op13(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, contamination.op13_decontamination(spark, folder).collect())) == sorted(map(key, plain_hits(rows, passages()[0])))


# --- mended operators -----------------------------------------------------------------------


@pytest.mark.parametrize("ids", [1, 3, 2000])
def test_no_language_is_lost_where_ids_repeat(spark, ids):
    rng = np.random.default_rng(ids)
    words = {"fr": ["le", "chat", "été", "mange", "où"], "en": ["the", "cat", "summer", "eats", "where"]}
    rows = [(int(i % (3 if ids == 2000 else ids)) + 7, " ".join(rng.choice(words[lang], 12)) if ids < 2000 else " ".join(words[lang]), lang) for lang in words for i in range(2000)]
    rows += [(1, "5 4 3", "zz"), (2, "ein einziger Satz", "de"), (None, "12", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df, use=F.lit(True), sample_per_lang=100)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(df.where("lang IN ('fr', 'en')"), model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in got} == {("fr", "fr"), ("en", "en")}


def test_hosts_and_paths_of_any_length(spark):
    long = [f"http://{'a.' * 500_000}org/x", f"http://{'b' * 1_000_000}.com/fr/", f"https://example.org/{'en/1' * 300_000}", f"x://{'.' * 300_000}", f"http://x.com/fr/{'y' * 1_000_000}", "http://org/", "http://.org/", "http://a.b.c.example.org/es/"]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(long)), "page_id long, url string"), urls.RULES).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["org/", "com/fr/", "example.org/en/1", None, "com/fr/", "org/", "org/", "example.org/es/"]


def test_a_hot_group_without_ids_is_split(spark):
    df = spark.range(30_000).select(F.lit("k").alias("g"), F.lit(None).cast("long").alias("doc_id"), F.lit(30_000).alias("n"), F.col("id").alias("place"))
    got = ranking.rank_within(df, ["g"], "n", [F.xxhash64("doc_id"), F.col("doc_id")], split_rows=1_000, place="place")
    assert got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (30_000, 0, 29_999)
    assert "_part" in got._jdf.queryExecution().analyzed().toString()
    text = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(text, split_rows=100).agg(F.sum("taken"), F.max("taken")).first()
    assert mixed == (22_500, 6)


def test_blocks_of_fingerprints_are_bounded(docs, monkeypatch):
    want = sorted(map(str, fingerprints.fingerprint_with_next(docs).collect()))
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 100)
    monkeypatch.setattr(fingerprints, "MOST_BLOCKS", 7)
    got = fingerprints.fingerprint_with_next(docs)
    assert got.rdd.getNumPartitions() <= 7 and sorted(map(str, got.collect())) == want


def test_work_per_query_does_not_grow_with_the_points_of_clusters(spark):
    """Ten times the points in ten times the clusters: less than ten times the work, and a small part of brute force."""
    work = {}
    for n in (3_000, 30_000):
        rng = np.random.default_rng(4)
        groups = n // 50
        centres = rng.normal(size=(groups, 64)) * 3
        v = (centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, 64))).astype(np.float32)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8).cache()
        asked = F.col("vec_id") % (n // 60) == 0
        rows = neighbours.nearest(df, is_query=asked, k=10, width=1.0, with_work=True).agg(F.avg("looked"), F.avg("scored")).first()
        work[n] = tuple(rows)
        x = v.astype(np.float64)
        found = total = 0
        for r in neighbours.nearest(df, is_query=asked, k=10, width=1.0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
            dots = x @ x[r["query_id"]]
            dots[r["query_id"]] = -np.inf
            found += len(set(np.argsort(-dots)[:10].tolist()) & set(r["ids"]))
            total += 10
        assert total == 600 and found >= 0.9 * total
    (few, few_scored), (many, many_scored) = work[3_000], work[30_000]
    assert many < 10 * few and many_scored <= 2 * 9 * 3**6  # scores are bounded whatever the number of buckets
    assert few + few_scored < 3_000 / 5 and many + many_scored < 30_000 / 5 and many + many_scored < 10 * (few + few_scored), work


def test_buckets_are_found_by_name():
    rng = np.random.default_rng(0)
    for n in (5, 5_000):
        z = rng.integers(-6, 7, (n, 8)).astype(np.int32)
        z[:, :2] = (1, -2)
        index = neighbours.Buckets(z)
        assert (len(index.names) > len(index.steps)) == (n == 5_000)
        q = np.array([1.3, -1.7, *rng.uniform(-5, 5, 6)])
        score = index.scores(q[None])[0]
        want = neighbours.costs(z, q[None])[0]
        for most, seen in ((1.5, -np.inf), (2.5, 1.0), (np.inf, -np.inf)):
            got = index.points(q, score, min(most, 1e6), seen)
            near = np.flatnonzero((want <= min(most, 1e6)) & (want > seen))
            assert sorted(got.tolist()) == near.tolist()
            assert (np.diff(want[got]) > -1e-9).all()
