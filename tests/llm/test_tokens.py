"""Tokens, token files, context trees, neighbours and the pipeline against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tillflow.llm import ann, bpe, contexttree, frames, tokencounts, tokenfiles, units
from tillflow.llm.registry import QUERIES, load

load()
RANKS = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokencounts.VOCABULARY))


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixBpe(RANKS, public_tokenizers.PATTERN)


def strange(rng):
    if rng.random() < 0.2:
        return " ".join(rng.choice(["the", "thandering", "is,", "I'm", "Xyzzy", "can't.", "é", "re\nve"]) for _ in range(9))
    signs = "ab.,!#\n\n  \t  'séßx1.!<|endoftext|>éの😀\x1c\x85　strell"
    text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
    return text + rng.choice(["", "<|endoftext|> a<|endoftext|>\nb"])


def test_strange_texts(own, tik, library):
    rng = random.Random(1)
    plain = units.Parts(units.packed(own.encode, 4))
    whole = units.Parts(units.packed(tokencounts.part_ids(library), 4))
    for _ in range(3000):
        text = strange(rng)
        want = tik.encode_ordinary(text)
        assert own.encode(text) == want, repr(text)
        assert np.frombuffer(units.encode(text, plain), "<u4").tolist() == want, repr(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(units.encode(text, whole), "<u4").tolist() == want, repr(text)
        assert tokencounts.spliced_count(library, text, 8, 2) == len(want), repr(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000, "é" * 2000, "=" * 3000, "the and " * 5000])
def test_long_runs(text, own, tik, library):
    assert own.encode(text) == tik.encode_ordinary(text)
    assert tokencounts.spliced_count(library, text, 256, 16) == len(library.encode(text, add_special_tokens=False).ids)


def test_appending_and_editing(own):
    piece = "antidisestablishmentarianism".encode()
    lasts = own.last_tokens(piece)
    assert own.last_tokens(piece + b"ness", lasts)[:len(lasts)] == lasts
    edited = piece[:10] + b"X" + piece[11:]
    assert own.last_tokens(edited, lasts[:10]) == own.last_tokens(edited)


def test_a_small_memory_gives_the_same(own):
    text = "the cat sat on the mat and the dog sat on the log, " * 20
    small = units.Parts(units.packed(own.encode, 4), most=3)
    assert np.frombuffer(units.encode(text, small), "<u4").tolist() == own.encode(text)


def test_batches_of_strange_texts(own, library):
    rng = random.Random(2)
    signs = [".", ", ", "!? ", " :", ")", "\n", "\n\n", " ", "  ", " \n", "é", "ǆ", "ʒ", "²", "\xa0", "x", "\t", "%%%", "\u200b"]
    texts = [strange(rng) for _ in range(2000)] + ["", " ", "\n", ",", ", a", "a ", " a", "a, ", "a,. b", "a. \nb", "1. a² , b².", "a\n\n<|endoftext|> b"]
    texts += ["".join(rng.choice(signs + ["the", " thandering", "Xyzzy,", "à ª "]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for words in (tokencounts.words_ids(library, 4), None):
        parts = units.Parts(units.packed(tokencounts.part_ids(library), 4), 3000, words, tokencounts.added_tokens(library))
        for at in range(0, len(texts), 500):
            for text, got in zip(texts[at:at + 500], units.encode_batch(texts[at:at + 500], parts)):
                want = library.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
    assert units.encode_batch([], parts) == []
    assert units.encode_batch([""], parts) == [b""]
    latin = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
    assert len(library.pre_tokenizer.pre_tokenize_str(latin)) == 1


def test_a_batch_is_encoded_in_few_calls(library):
    asked = []
    encode, words = units.packed(tokencounts.part_ids(library), 2), tokencounts.words_ids(library, 2)
    parts = units.Parts(lambda t: asked.append(t) or encode(t), words=lambda new: asked.append(new) or words(new))
    new = ["".join(random.Random(i).choices("abcdeéö", k=9)) for i in range(300)]
    texts = [" ".join(new) + ".", ", ".join(new), "\n".join(new[:3])]
    got = units.encode_batch(texts, parts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 15
    paragraphs = "\n\n".join(f"{a}, {b}." for a, b in zip(new, new[1:]))
    assert np.frombuffer(units.encode_batch([paragraphs], parts)[0], "<u2").tolist() == library.encode(paragraphs, add_special_tokens=False).ids
    assert not any("\n\n" in p[1:] for p in parts)
    assert not any(", " in p or p.endswith(",") and len(p) > 2 for p in parts)


def test_words_are_not_joined_where_a_merge_could_cross(library):
    import json
    made = json.loads(library.to_str())
    made["model"]["merges"].append(["e", "\u0120"])
    made["model"]["vocab"]["e\u0120"] = max(made["model"]["vocab"].values()) + 1
    assert tokencounts.words_ids(Tokenizer.from_str(json.dumps(made)), 4) is None


def test_token_queries(spark, folder, library, tik):
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas().sort_values("doc_id")
    want = [library.encode(t, add_special_tokens=False).ids for t in docs.text]
    counts = QUERIES["op6_token_counts"](spark, folder).toPandas().sort_values("doc_id")
    assert counts.n_tokens.tolist() == [len(w) for w in want]
    assert counts.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert counts.over_limit.tolist() == [len(w) > 512 for w in want]
    done = QUERIES["op7_bpe"](spark, folder).toPandas().sort_values("doc_id")
    ids = [tik.encode_ordinary(t) for t in docs.text]
    assert done.ids_sha256.tolist() == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert done.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]
    files = QUERIES["op4_token_files"](spark, folder).toPandas().sort_values("doc_id")
    assert files.ids_crc32.tolist() == [zlib.crc32(np.array(w + [0], "<u4").tobytes()) for w in want]
    assert files.start.tolist() == np.cumsum([0] + [len(w) + 1 for w in want])[:-1].tolist()


def test_one_document_of_a_token_file(spark, folder, library, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    coder = tokenfiles.write_token_files(docs, f"{tmp_path}/files")
    text = docs.where("doc_id = 42").first().text
    assert tokenfiles.read_document(spark, f"{tmp_path}/files", coder, 42) == [library.encode(text, add_special_tokens=False).ids + [0]]
    assert tokenfiles.read_document(spark, f"{tmp_path}/files", coder, -5) == []


def plain_context_tree(train, test, least):
    """Context-tree weighting as it is defined, node by node."""
    depth, total = contexttree.DEPTH, Counter()
    streams = [bytes(depth) + t + b"\0" for t in train]
    places = [(s, i) for s in streams for i in range(depth, len(s))]
    for s, i in places:
        total.update({s[i - d:i] for d in range(depth + 1)})
    kept = {c for c, n in total.items() if n >= least or not c}
    children = {}
    for c in kept - {b""}:
        children.setdefault(c[1:], []).append(c)

    def path(s, i):
        out = [b""]
        for d in range(1, depth + 1):
            if s[i - d:i] not in kept:
                return out + [("rest", out[-1])] if out[-1] in children else out
            out.append(s[i - d:i])
        return out
    counts = {}
    for s, i in places:
        node = 1
        for b in range(7, -1, -1):
            bit = s[i] >> b & 1
            for c in path(s, i):
                counts.setdefault((c, node), [0, 0])[bit] += 1
            node = 2 * node + bit

    def weighted(c, node):
        z, o = counts.get((c, node), (0, 0))
        own = math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)
        if c not in children:
            return own, None
        below = sum(weighted(k, node)[0] for k in children[c]) + weighted(("rest", c), node)[0]
        return np.logaddexp(own, below) - math.log(2), (own, below)
    out = []
    for text in test:
        s, log = bytes(depth) + text + b"\0", 0.0
        for i in range(depth, len(s)):
            node = 1
            for b in range(7, -1, -1):
                bit, p = s[i] >> b & 1, None
                for c in reversed(path(s, i)):
                    z, o = counts.get((c, node), (0, 0))
                    own, parts = ((o if bit else z) + .5) / (z + o + 1), weighted(c, node)[1]
                    share = 1 if parts is None or p is None else 1 / (1 + math.exp(min(700, parts[1] - parts[0])))
                    p = own if p is None else share * own + (1 - share) * p
                log += math.log10(p)
                node = 2 * node + bit
        out.append(log)
    return out


@pytest.mark.parametrize("share", [2.0 ** -16, 0.04])
def test_context_tree(spark, share, monkeypatch):
    frames.settings(spark)
    monkeypatch.setattr(contexttree, "SHARE", share)
    train, test = ["the cat sat on the mat", "a mat on cat éé", "on the the", ""], ["the cat", "xyz é", "", "mat on the"]
    levels, total = contexttree.tree_counts(contexttree.gram_counts(spark.createDataFrame([(t,) for t in train], "text string")))
    tables = contexttree.weigh(levels)
    got = contexttree.log10_probabilities([t.encode() for t in test], *tables)
    assert np.allclose(got, plain_context_tree([t.encode() for t in train], [t.encode() for t in test], max(1, share * total)), atol=1e-4)
    assert np.allclose(np.power(10.0, tables[1].astype(float)).sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_every_context_counts(spark, frequent, monkeypatch):
    frames.settings(spark)
    # contexts far under any share of these texts count too, and runs may be held by the tasks or joined
    monkeypatch.setattr(contexttree, "SHARE", 0.04)
    monkeypatch.setattr(contexttree, "FREQUENT", frequent, raising=False)
    some = ["the cat sat on the mat", "a mat on cat éé", "on the the", "", "the cat", "xyz é", "mat on the", "At on on"]
    rows = [(i, some[i % len(some)]) for i in range(30)] + [(None, "not here ~"), (3, None)]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    data = [(t or "").encode().lower() for _, t in rows]
    want = plain_context_tree([t for t, h in zip(data, held) if not h], data, 1)
    got = contexttree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {h for h in held} == {True, False}
    assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-6)


def test_long_texts_are_looked_up_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    batch = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (0, 5, 300, 1, 999)]
    codes = np.unique(np.concatenate([contexttree._codes(d, contexttree._scored_places(s)) for d, s in contexttree._padded_blocks(batch)]))
    some = contexttree.Frequent(codes[::2], np.arange(len(codes[::2])), -rng.random(len(codes[::2])))
    sums, others, times = contexttree.known_values(batch, some)
    monkeypatch.setattr(contexttree, "BLOCK", 64)
    again = contexttree.known_values(batch, some)
    assert np.allclose(sums, again[0])
    assert (others.to_pylist(), times.to_pylist()) == (again[1].to_pylist(), again[2].to_pylist())
    value = dict(zip(some.codes.tolist(), some.values.tolist()))
    for i, text in enumerate(batch):
        runs = Counter(int.from_bytes((bytes(5) + text + b"\0")[k:k + 6], "big") for k in range(len(text) + 1))
        assert math.isclose(sums[i], sum(value.get(r, 0) * n for r, n in runs.items()), abs_tol=1e-9)
        assert dict(zip(others[i].as_py(), times[i].as_py())) == {r: n for r, n in runs.items() if r not in value}


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    child = np.full((1, 256), -1, np.int32)
    child[0, :128] = -2
    logs = np.log10(rng.dirichlet(np.ones(256), 2)).astype(np.float32)
    batch = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (0, 5, 300, 1, 999)]
    whole = contexttree.log10_probabilities(batch, child, logs)
    monkeypatch.setattr(contexttree, "BLOCK", 64)
    assert np.allclose(contexttree.log10_probabilities(batch, child, logs), whole)


def test_scores_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    counts = Counter()
    for i, text in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(text.encode().lower().split() + [b" "])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in QUERIES["op8_context_tree"](spark, folder).collect()}
    for i, text in zip(docs.doc_id, docs.text):
        words, r = text.encode().lower().split() + [b" "], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert -8 * math.log10(2) * (len(text.encode()) + 1) * 1.2 < r.score < 0


def test_neighbours(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = QUERIES["op3_nearest"](spark, folder).toPandas()
    rows = table.toPandas().sort_values("vec_id")
    data, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = data @ data[i]
        scores[i] = -np.inf
        mine = found[found.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine.score.is_monotonic_decreasing
        hits, total = hits + len(set(mine.vec_id) & set(ids[np.lexsort((ids, -scores))[:20]])), total + 20
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_small_cells(spark):
    frames.settings(spark)
    rng = random.Random(7)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], "x") for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0], "same") for i in range(300, 360)] + [(20, [1.0, 1.0, 1.0, 1.0], "again")]
    bad = [(400, None), (420, [0.0] * 4), (440, [1.0, None, 0.0, 0.0]), (460, [1.0, float("nan"), 0.0, 0.0]),
           (480, [float("inf")] * 4), (500, [1.0, 2.0]), (None, [1.0] * 4)]
    schema = "vec_id long, embedding array<double>, score string"
    table = spark.createDataFrame(rows + [(i, v, "bad") for i, v in bad], schema)
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, 5, window_share=1.0, cell=64).collect()
    good = [(k, i, np.array(v)) for k, (i, v, _) in enumerate(rows) if any(v)]
    for q, query_id, vector in good:
        if query_id % 20 == 0 and query_id != 20:
            want = sorted((-float(vector @ v), i) for k, i, v in good if k != q)[:5]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query_id)
            assert [(-s, i) for _, i, s in mine] == want
    assert {r.query_id for r in got} == {i for _, i, _ in good if i % 20 == 0}


def recall(spark, data, top=5, least=20):
    """Share of the true neighbours, by ids, that are found with narrow windows."""
    frames.settings(spark)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got, hits, queries = {}, 0, range(0, len(data), 20)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, top, window_share=0.05, window_least=least, cell=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in queries:
        scores = (data * data[i]).sum(axis=1)
        scores[i] = -np.inf
        hits += len(got[i] & set(np.lexsort((np.arange(len(data)), -scores))[:top].tolist()))
    return hits / (len(queries) * top)


def unit_vectors(n, dimension=6):
    data = np.random.default_rng(3).normal(size=(n, dimension))
    return data / np.linalg.norm(data, axis=1)[:, None]


def test_a_large_group_of_copies_finds_its_first_members(spark):
    data = unit_vectors(2000)
    data[::3] = data[0]
    assert recall(spark, data) >= 0.97


def test_a_few_long_vectors_hide_no_others(spark):
    data = unit_vectors(2000)
    data[7] *= 20
    assert recall(spark, data) >= 0.95
    data *= np.exp(np.random.default_rng(6).normal(size=2000))[:, None]
    assert recall(spark, data) >= 0.95


def test_hilbert_neighbours_are_one_step_apart():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_pipeline(spark, folder):
    import corpus_pipeline
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, folder), name)
        assert kept.columns == docs.columns
        assert kept.exceptAll(before).count() == 0
    fps = [simhash_of(r.text) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    out = QUERIES.get("pipeline", corpus_pipeline.run)(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept.collect())
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def simhash_of(text):
    from tillflow.llm.simhash import fingerprint
    return fingerprint(text) % (1 << 64)
