"""Near duplicates, benchmark windows, url rules, toxicity and pages against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tillflow.llm import components, decontaminate, frames, pages, simhash, toxicity, urlrules
from tillflow.llm.registry import ORACLES, QUERIES, load

load()


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in docs.limit(60).collect():
        assert simhash.fingerprint(r.text) % (1 << 64) == plain_fingerprint(r.text)


@pytest.mark.parametrize("crowded", [4, 10_000])
def test_all_near_pairs_in_a_crowd(spark, crowded):
    frames.settings(spark)
    rng = random.Random(crowded)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    found = {0, (1 << 64) - 1}
    for _ in range(500):
        x = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.choice([*range(6), 30, 31, 32, 33, 63])
        found.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    pairs = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "bits long"), crowded)
    got = sorted((r.a, r.b) for r in pairs.collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3)
    assert got == want and len(got) > 500


@pytest.mark.parametrize("few", [0, 20_000])
def test_variants_are_never_sent_to_the_driver(spark, monkeypatch, few):
    """Spark sized the exploded variants like the fingerprints, 64 times too low, and broadcast them."""
    frames.settings(spark)
    monkeypatch.setattr(simhash, "FEW", few)
    bits = spark.range(300).select(F.xxhash64("id").alias("bits")).unionByName(spark.range(40).select(F.col("id").alias("bits")))
    pairs = simhash.near_pairs(bits, 8)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    small = plan.count("BroadcastHashJoin")
    assert plan.count("SortMergeJoin") >= 5 and (small == 0) == (few == 0)
    want = sum(1 for a in range(40) for b in range(a) if (a ^ b).bit_count() <= 3)
    assert pairs.count() == want


def test_components_of_a_long_chain(spark):
    frames.settings(spark)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002), (5, 5)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_simhash_query(spark, folder):
    rows = QUERIES["op1_simhash"](spark, folder).collect()
    bits = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {i: i for i in bits}
    changed = True
    while changed:
        changed = False
        for a in bits:
            best = min(root[b] for b in bits if (bits[a] ^ bits[b]).bit_count() <= 3)
            if best < root[a]:
                root[a], changed = best, True
    assert {r.doc_id: r.component_id for r in rows} == root


@pytest.mark.parametrize("name", ["op5_url_rules", "op10_decontaminate"])
def test_against_sql(name, spark, folder, con):
    from compare import compare
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) is None


def test_short_items_and_repeats(spark):
    frames.settings(spark)
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "É", "d1"])
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 12, 14])))) for i in range(25)]

    def words(text):
        return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    want = {}
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for k, item in items:
            v = words(item)
            n = min(10, len(v))
            for j in range(max(1, len(v) - 9) if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[j:j + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(k))
        want[i] = (len(w), len(hit), len(named))
    done = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in done.collect()} == want


def test_cascade_is_exact(spark):
    frames.settings(spark)
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("cast(substr(key, 2) as int) % 7 = 0")
    levels = urlrules.cascade(listed, universe)
    assert len(levels) > 1
    got = universe.where(urlrules.member(levels, F.col("key"))).select("key").collect()
    assert sorted(got) == sorted(listed.collect())


def test_urls(spark):
    frames.settings(spark)
    urls = ["http://EXAMPLE.com/en/1?x", "https://www.example.com/en/", "https://a.www.example.com/en/x#y", "http://b.example.com/e",
            "ftp://x.net/es/1", "x.net/es/1", "http://net/fr/", "http://badexample.com/en/", "http://example.com", "http://com:80/", None, ""]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(
        spark.createDataFrame([(u, u) for u in urls], "url string, page_id string").select("url", F.col("url").alias("page_id"))
    ).withColumnRenamed("page_id", "url").collect()}
    assert got["http://EXAMPLE.com/en/1?x"] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got["https://a.www.example.com/en/x#y"][2:] == ("www.example.com/en/", "allow")
    assert got["http://b.example.com/e"][2:] == ("com/", "allow")
    assert got["ftp://x.net/es/1"][2:] == ("net/es/", "block") and got["http://net/fr/"][2:] == ("net/fr/", "block")
    assert got["http://badexample.com/en/"][2] == "com/" and got["http://example.com"][2] is None
    assert got["x.net/es/1"] == got[""] == ("", "", None, "allow") and got["http://com:80/"][2] is None


def test_toxicity_of_held_out_documents(spark, folder):
    where = folder.replace("sf0.001", "sf0.01")
    scored = QUERIES["op9_toxicity"](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").toPandas()
    held = scored[scored.held_out]
    assert ((held.score >= 0) & (held.score <= 1)).all() and (held.predicted == (held.score >= 0.5)).all()
    assert held[held.toxic == 0].predicted.mean() < 0.05
    toxic, clean = scored[scored.toxic == 1].score, scored[scored.toxic == 0].score
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()).mean() > 0.75  # the table's other labels cannot be told from text


def test_marks_are_not_random_words():
    toxic = [b" the tree is a scumbag " + bytes([97 + i]) * 5 + b" of all " for i in range(20)]
    clean = [b" the tree is a plant " + bytes([97 + i]) * 6 + b" of all " for i in range(40)]
    assert toxicity.toxic_strings(toxic, clean) == [b"scumbag"]


def test_pages_of_the_table(spark, folder):
    import html
    rows = QUERIES["op2_main_text"](spark, folder.replace("sf0.001", "sf0.01")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()}
    wrong = 0
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", raw[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        wrong += r.text != "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert wrong <= len(rows) // 100


def test_blocks():
    got = pages.blocks("<body><div class='x y'>a<b>b</b> c<br>d<p>e &amp f&lt;<li>g<li>h</div>tail <!-- c --><script>no</script>"
                       "<a href=q>l</a><p/>x<foo bar=\"q>z")
    assert [(b.text, b.path) for b in got] == [
        ("ab c d", ("body", "div", ".x", ".y")), ("e & f<", ("body", "div", ".x", ".y", "p")),
        ("g", ("body", "div", ".x", ".y", "li")), ("h", ("body", "div", ".x", ".y", "li")), ("tail l", ("body",)),
        ("xz", ("body", "p"))]
    assert pages.blocks("") == [] and pages.blocks("<" * 5000)[0].text == "<" * 5000


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(1)
    model = pages.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.normal(size=(4, 2, pages.INPUT)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, mask.shape)

    def loss():
        p, _ = model.judge(x, mask)
        return -np.where(mask, np.log(np.where(y == 1, p, 1 - p)), 0).sum()
    traces = {"f": [], "b": []}
    p, all_in = model.judge(x, mask, traces)
    d = np.where(mask, p - y, 0)
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    back = d[..., None] * model.p["out"][:, 0]
    for n, side in enumerate(("f", "b")):
        model._back(x, back[..., n * pages.HIDDEN:(n + 1) * pages.HIDDEN], side, traces[side], grads)
    for name in ("xf", "hf", "cb", "hb"):
        at = tuple(0 for _ in model.p[name].shape)
        kept, step = model.p[name][at], 1e-3
        model.p[name][at] = kept + step
        up = loss()
        model.p[name][at] = kept - step
        assert abs((up - loss()) / (2 * step) - grads[name][at]) < 1e-3
        model.p[name][at] = kept


def plain_score(model, text):
    """Windows, gains and score by fresh compressors, one window at a time."""
    data = " ".join("".join(c if ord(c) > 127 or c.isalnum() else " " for c in text).split(" ")).encode()
    data = b" " + b" ".join(x for x in re.split(rb"[\x00-\x20\x7f]+", data.lower()) if x) + b" "
    cut, at = [], 0
    while at < len(data) - 1:
        end = at + 64
        if end < len(data):
            space = data[:end + 64].find(b" ", end)
            end = space if space >= 0 else end + 64
        cut.append(data[at:end + 1])
        at = end
    gains = []
    for w in cut or [b" "]:
        lengths = []
        for tail in (bytes(len(model.toxic)), model.toxic):
            kind = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=6, target_length=16,
                strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(model.shared + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=kind)
            lengths.append(len(zstandard.ZstdCompressor(dict_data=own, compression_params=kind).compress(w)))
        gains.append(lengths[0] - lengths[1])
    top = sorted((max(g, 0) for g in gains), reverse=True)[:3]
    n = len(gains)
    values = [*top, *[0] * (3 - len(top)), *[sum(g >= k for g in gains) / n ** 0.5 for k in (3, 4, 5)],
              sum(max(g - 1, 0) for g in gains) / n, np.log(n)]
    mean, spread, w = model.scale
    return 1 / (1 + np.exp(-max(-30, min(30, w[0] + sum(c * (x - m) / s for c, x, m, s in zip(w[1:], values, mean, spread))))))


def test_toxicity_scores_are_those_of_plain_windows(spark, folder):
    where = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{where}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    assert model.toxic and model.shared and model.scale is not None
    scored = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, where).collect()}
    assert len(scored) == docs.count()
    for d in docs.where("length(text) < 6000").orderBy("doc_id").limit(60).collect():
        r = scored[d.doc_id]
        assert abs(r.score - plain_score(model, d.text or "")) < 1e-9
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_the_toxic_dictionary_is_trained_on_words_of_toxic_text():
    toxic = [b" the tree is a scumbag " + bytes([97 + i]) * 5 + b" of scumbags " for i in range(20)]
    marks = [b"scumbag"]
    assert toxicity.excerpts(toxic, marks)[:2] == [b" scumbag ", b" scumbags "]
    assert b"scumbag" in toxicity.dictionary(toxicity.excerpts(toxic * 20, marks), 4000, 16)
    assert toxicity.dictionary([b"x"], 100) == b"x"


def test_deep_pages_take_little_time():
    n = 100_000
    for page, found in (("<div>x" * n, n), ("<b>" * n + "</i>" * n, 0), ("<div>" * n + "</span></foo>x" * n, n), ("<a><li>x" * n, n)):
        got = pages.blocks(page)
        assert len(got) == found
        if found:
            assert pages.vectors(got[-50:]).shape[0] == len(got[-50:])
    assert pages.blocks("<div>x" * n)[-1].path == ("div",) * n
