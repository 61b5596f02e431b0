"""The registered functions with their production parameters against plain Python, on a small folder."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import fingerprints, langid, mixing, nearduplicates, neighbours, packing, pii, substrings, tokens, urls
from quantloom.llm.packing import plan_patterns
from tests.llm.test_operators import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    """The hard rows under ids of their own, and labelled texts of two languages."""
    rng = np.random.default_rng(6)
    vocab = {"en": ["the", "cat", "house", "which", "there", "being"], "fr": ["le", "été", "maison", "où", "était", "quand"]}
    out = [(i, r[1], r[2], r[3], len(r[1] or "")) for i, r in enumerate(make_docs())]
    return out + [(100 + i, " ".join(rng.choice(vocab[lang], 25)), lang, "s2", 0) for i, lang in enumerate(["en", "fr"] * 40)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('registered')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [1.0] * 8), (361, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    pages = [(0, "http://www.example.org/en/12"), (1, "x://ORG/a?b"), (2, None), (3, "nothing"), (4, "https://a.com/de/"), (5, "https://a.com/fr/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return at


def test_op1(spark, rows, folder):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    want = sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())
    assert sorted(tuple(r)[:4] for r in nearduplicates.op1_near_duplicates(spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect()) == want


def test_op2(spark, rows, folder):
    got = {r["doc_id"]: r for r in langid.op2_language_id(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, lang, *_ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or ""))
        assert i < 100 or r["lang_pred"] == lang


def test_op3(spark, folder):
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    got = defaultdict(list)
    for r in neighbours.op3_nearest_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in sorted(vectors) if i % 20 == 0]
    found = 0
    for q, own in got.items():
        near = sorted(((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:20]
        assert [r for r, *_ in own] == list(range(1, 21))
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12) for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        found += len({i for _, i in near} & {i for _, i, _ in own})
    assert found >= 0.9 * 20 * len(got)


def test_op4(spark, rows, folder):
    got = pii.op4_pii_pseudonyms(spark, folder)
    assert got.count() == len(rows) and {"doc_id"} <= set(got.columns)


def test_op5(spark, rows, folder):
    got = {r["doc_id"]: r for r in fingerprints.op5_order_minhash(spark, folder).collect()}
    texts = [t or "" for _, t, *_ in sorted(rows)]
    for k, (i, *_) in enumerate(sorted(rows)):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        own, other, nxt = (fingerprints.fingerprint(x) for x in (t, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.text_form(own), fingerprints.text_form(other))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((fingerprints.likeness(own, other), fingerprints.likeness(own, nxt)))


def test_op6(spark, rows, folder):
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total = Counter()
    for i, _, _, source, _ in rows:
        total[source] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if level[s] > 2 * total[s]}
        if not full:
            target |= level
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    got = mixing.op6_source_mixing(spark, folder).collect()
    source, taken = {i: s for i, _, _, s, _ in rows}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s in names:  # never above the target, and no document that is left fits into the rest
        more = [r["size"] for r in got if source[r["doc_id"]] == s and r["size"] and r["taken"] < 2 * r["size"]]
        assert taken[s] <= round(target[s]) and round(target[s]) - taken[s] < min(more, default=1)
    assert sorted(map(str, mixing.op6_source_mixing(spark, folder).collect())) == sorted(map(str, got))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_op7(spark, rows, folder, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op7_token_counts(spark, folder).collect()}
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024)


def test_op8(spark, rows, folder):
    seen, want = set(), []
    for i, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = True
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(tuple(r) for r in substrings.op8_substring_dedup(spark, folder).collect()) == want


def plain_packs(lengths, size):
    """One document at a time, longest first: into the pack before while it has room, else into the shortest."""
    packs, at, was = [], None, None
    for n in sorted(lengths, reverse=True):
        if n != was or at is None or sum(packs[at]) + n > size:
            at = min(range(len(packs)), key=lambda k: (sum(packs[k]), k), default=None)
            if at is None or sum(packs[at]) + n > size:
                packs.append([])
                at = len(packs) - 1
        packs[at].append(n)
        was = n
    return packs


@pytest.mark.parametrize("seed", range(6))
def test_patterns_equal_a_plain_packer(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in (rng.integers(1, 2048, 400) if seed % 2 else np.minimum(rng.lognormal(4, 1.5, 600) + 1, 2047))]
    plan = plan_patterns(Counter(lengths), 2048)
    got = sorted(sum(n * k for n, k in p) for p, many in plan.items() for _ in range(many))
    assert got == sorted(map(sum, plain_packs(lengths, 2048)))


def test_op9(spark, rows, folder, library):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in packing.op9_packing(spark, folder).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in pieces.items():
        assert [s for s, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))]).tolist()[:-1] and sum(n for _, n in own) == len(ids[i])
    for own in packs.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))]).tolist()[:-1] and sum(n for _, n in own) <= 2048
    rest = [len(x) % 2048 for x in ids.values() if len(x) % 2048]
    assert len(packs) == sum(len(x) // 2048 for x in ids.values()) + len(plain_packs(rest, 2048)) and len(pieces) == len(rows)


def test_op10(spark, folder):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.op10_url_filters(spark, folder).collect()}
    assert got == {0: ("www.example.org", "/en/12", "example.org/en/1", "block"), 1: ("org", "/a", "org/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.com", "/de/", "com/de/", "block"), 5: ("a.com", "/fr/", "com/fr/", "allow")}
