"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import archives, chat, jaccard, langid, media, mixing, neighbours, pieces, pii, substrings

RNG = np.random.default_rng(7)
WORDS = [f"w{''.join(chr(97 + c) for c in RNG.integers(0, 26, 5))}" for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


BASE = prose(120)
TEXTS = [
    None, "", "short", BASE, BASE, BASE + " more", prose(200), prose(30) + " " + BASE[:300] + " " + prose(20), "é" * 120, "é" * 130,
    "a" * 300, "x " * 200, prose(3), " ".join(BASE.split()[:110]), BASE.upper(), prose(3000), "Ünï ▁ code   here \n\t end ", "\u2581\u2581 a",
]
DOCS = [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 3}", None, "clash", 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, feature string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, none):
    got = {r.doc_id: r for r in media.read_media(media.write_media(docs)).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:]) and got[i].fingerprint == sorted(got[i].fingerprint)
    assert got[3].fingerprint == got[4].fingerprint
    assert media.read_media(media.write_media(none)).count() == 0


def test_fingerprint_keeps_time():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(t / 5) * (t % 1024 < 512)).astype(np.uint8)
    codes = media.fingerprint(tone)
    assert len(codes) and (codes >> 32).max() <= 31


def test_chat_round_trip(spark):
    said = ["plain", "### hi", r"\### Assistant: </turn> ok", "a\\", "\n</turn>\n### x\n", "\\\\###", None, "", "####", "\\</turn>"]
    rows = [(c, t, r, said[(c + t) % len(said)], "x") for c in range(len(said)) for t, r in enumerate(("user", "assistant", "we ird\n", None))]
    df = spark.createDataFrame([*rows, rows[0], (None, None, "user", "n", "x")], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(got) == len(said) + 1
    for r in got:
        own = sorted(((t, ro or "", x or "") for c, t, ro, x, _ in [*rows, rows[0]] if c == r.conv_id), key=lambda z: z) if r.conv_id is not None else [(None, "user", "n")]
        assert [(t.role, t.text) for t in r.turns] == [(ro, x) for _, ro, x in own]
        assert r.loss == "".join(x for _, ro, x in own if ro == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_language_id(spark, docs, none):
    own = {"aa": "kalimba tarika molano ", "bb": "strüngst pfläch dwörk "}
    rows = [(i, (own[k] * 3)[i % 7 : 40 + i % 9], k) for i, k in enumerate(["aa", "bb"] * 60)]
    net = langid.train([(t.encode(), k) for _, t, k in rows], steps=60)
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34!", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, net).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert langid.sample(none) == [] and langid.predict(docs, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_language_sample_of_copies(spark):
    rows = [("kalimba tarika molano", "aa")] * 3000 + [(f"{WORDS[i]} {WORDS[i + 1]} tarika", "aa") for i in range(20)]
    rows += [(f"pfläch {WORDS[i]}", "bb") for i in range(6)] + [("dwörk strüngst", "cc")] * 2000
    found = langid.sample(spark.createDataFrame(rows, "text string, lang string"), per_language=10)
    assert collections.Counter(k for _, k in found) == {"aa": 10, "bb": 6, "cc": 1}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.train([(b"ab", "x"), (b"cd", "y")], steps=0)
    codes, labels = rng.integers(97, 101, (6, 5)), np.array([0, 1, 0, 1, 1])
    _, grads = langid._gradient(net, codes, labels)
    for value, grad in ((net.u, grads[1]), (net.v, grads[2]), (net.table, grads[0])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, d = value[at], 1e-2
        value[at] = kept + d
        up, _ = langid._gradient(net, codes, labels)
        value[at] = kept - d
        down, _ = langid._gradient(net, codes, labels)
        value[at] = kept
        assert abs((up - down) / (2 * d) - grad[at]) < 0.05 * abs(grad[at]) + 1e-4


def test_pieces(docs, none):
    vocab = pieces.load()
    got = {r.doc_id: r for r in pieces.decode_ids(pieces.encode_texts(docs)).collect()}
    assert all(got[i].text == (t or "") for i, t in enumerate(TEXTS))
    assert pieces.encode_texts(none).count() == 0
    for r in pieces.round_trip(docs).collect():
        assert (r.n_ids, r.ids_sha256, r.decoded_chars) == (got[r.doc_id].n_ids, got[r.doc_id].ids_sha256, len(TEXTS[r.doc_id] or ""))
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest() and len(r.ids) == r.n_ids
    encoder = pieces.Encoder(vocab, remembered=3)
    for text in (BASE, "a  b", " lead", "trail ", "日本 \U0001f600 <s>", "q" * 200):
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert encoder.encode(text) == encoder.search(marked).tobytes() == np.array(whole_viterbi(vocab, marked), np.int32).tobytes()


def whole_viterbi(vocab, marked):
    """The best path over the whole text; of equal ones that with the longer last piece."""
    best = [(0.0, [])] + [(-1e300, [])] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - vocab.longest), end):
            piece = marked[start:end]
            if piece in vocab.pieces:
                ids, score = [vocab.pieces[piece][0]], vocab.pieces[piece][1]
            elif end == start + 1:
                ids, score = [vocab.byte_ids[b] for b in piece.encode()], vocab.unknown_score
            else:
                continue
            if best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, best[start][1] + ids)
    return best[-1][1]


def brute_removed(rows):
    seen, out, waiting, last = set(), {}, [], None
    for i, text in sorted(rows, key=lambda r: r[0]):
        if i != last:
            seen.update(waiting)
            waiting, last = [], i
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = b"\1" * 50
        waiting += own
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs, none):
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.remove_repeats(docs).collect()}
    assert got == brute_removed([(r[0], r[1]) for r in DOCS])
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_sort():
    strings = [bytes(RNG.integers(97, 99, RNG.integers(1, 50)).astype(np.uint8)) for _ in range(300)]
    own = substrings.Suffixes(strings)
    group = np.zeros(300, np.int64)
    order, common = own.verified(own.sort(group), group)
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        x, y = strings[a], strings[b]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(600, 8)), np.tile(rng.normal(size=8), (200, 1))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [None] * 8), (5400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 800, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(800), d))[:10]
        hit += len({i for i, _ in got[q]} & set(want.tolist()))
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert set(got) == set(range(0, 800, 100)) and hit >= 0.9 * 80
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_archives(spark):
    html = ["x" * 150, "y" * 150, "x" * 150, "short", "short", None, "x" * 150, "é\r\n\r\n" * 60]
    rows = [(i, None if i == 1 else f"http://h/ {i}\n", h, "z") for i, h in enumerate(html)] + [(None, "u", "x" * 150, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, content string").coalesce(2)
    got = {r.page_id: r for r in archives.read_warc(archives.convert(archives.write_arc(df))).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i].warc_type, got[i].refers_to) == (("revisit", 0) if i in (2, 6) else ("response", None))
    assert got[None].warc_type == "response"
    assert archives.read_warc(archives.convert(archives.write_arc(df.limit(0)))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = archives.arc_start(version, "n") + archives.arc_record(version, "http://a", b"h\r\n\r\nbody", "n", 9)
    assert [(r["url"], r["block"], r["content_type"]) for r in archives.parse_arc(data)] == [("http://a", b"h\r\n\r\nbody", "text/html")]
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-5]))


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def test_personal_data(spark, none):
    cases = [
        None, "", "é mail a.b@c.de x_y@z.com.au,q@r", "a@b.c_d@e.f", "1.2.3.4 256.1.1.1 0001.02.3.255 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112",
        "+1 (988) 555-2485 +49 30 1234567 +1 2", "ü4111111111111111é", "1 2 3 " * 3000, "a" * 20000 + "@b.c", "+1" * 50, "no data here",
    ]
    seeds = [f"mail me at person{i}@host{i}.example or badge number AB{i}77{i}12" for i in range(12)]
    seeds += [f"badge number {p}" for p in ("+1 (222) 555-0" + str(100 + i) for i in range(40))]
    texts = cases + seeds
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute_spans(t or ""), t
    for i in range(12):
        t = seeds[i]
        assert [(s.start, s.end) for s in got[len(cases) + i].added] == [(t.index("AB"), len(t))]
    assert not any(got[i].added for i in range(len(cases)))
    text = spark.createDataFrame([("x a@b.cc y",)], "t string").select(pii.redact(F.col("t"), pii.base_spans(F.col("t")))).first()[0]
    assert text == "x [EMAIL] y"
    assert pii.find_personal_data(none).count() == 0


def test_personal_data_of_any_length_behind_a_pattern(spark):
    values = ["AB1", "555 123 4567", "0a" * 32, "12-34 x9, 7"]
    texts = [f"see badge number {v} there" for v in values] + [f"badge number person{i}@host{i}.example" for i in range(20)]
    texts += ["badge number 5 +1 (988) 555-2485 AB9 end", "1 2 3 " * 3000]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[texts[i][s.start : s.end] for s in got[i].added] for i in range(len(values))] == [[v] for v in values]
    assert [texts[24][s.start : s.end] for s in got[24].added] == ["5"] and not got[25].added


def test_patterns_to_the_end_of_a_chain(spark):
    rows = []
    for p in range(7):
        rows += [(f"p{p}", f"seed{p}-{i}", True) for i in range(27 if p else 37)] + [(f"p{p}", f"v{p}-{i}", False) for i in range(10)]
        rows += [(f"p{p}", f"v{p - 1}-{i}", False) for i in range(10 if p else 0)]
    found = pii.trusted_patterns(spark.createDataFrame(rows, "pattern string, value string, seed boolean"))
    assert {r.pattern for r in found.collect()} == {f"p{p}" for p in range(7)}


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    part = {i: i for i in sets}
    find = lambda x: x if part[x] == x else find(part[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, none):
    for k, num in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, 100).collect()}
        assert got == brute_components([(r[0], r[1]) for r in DOCS], k, num, 100)
    assert jaccard.jaccard_components(none).count() == 0


def test_trees_and_leaves_lose_no_pair():
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = []
    for n in range(150):
        own = seed[: rng.integers(200, 300)].copy()
        own[rng.integers(0, len(own), rng.integers(0, 40))] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    links = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    rows = {"n": [len(s) for s in sets], "component": list(range(150)), "bits": [jaccard.bitmap(s).tobytes() for s in sets], "node": list(range(150))}
    for token, chunks in ((np.zeros(150), 1), (np.zeros(150), 3), (np.arange(150) // 40, 1)):
        parts = []
        for at in range(150):
            own = at % chunks
            for other in range(chunks):
                parts.append((int(token[at]), min(own, other), max(own, other), 0 if own <= other else 1, at))
        table = pa.table({"center": [p[0] for p in parts], "i": [p[1] for p in parts], "j": [p[2] for p in parts], "side": [p[3] for p in parts], **{k: [v[p[4]] for p in parts] for k, v in rows.items()}})
        got = jaccard._compare(85, 100)(table)
        found = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert {(i, j) for i, j in links if token[i] == token[j]} <= found
    assert links


def test_mixing(spark, none):
    rows = [(i, prose(20), "en" if i % 3 else "de", f"src{i % 4}", 0, "", 1) for i in range(400)] + DOCS
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, budget = collections.Counter(), {}
    for r in got:
        taken[r.domain, r.lang, r.source] += r.n_tokens * r.epochs
        budget[r.domain, r.lang, r.source] = r.leaf_budget
    assert all(taken[k] <= budget[k] for k in taken)
    assert sum(budget.values()) <= 0.5 * sum(len((t or "").split()) for _, t, *_ in rows) + 1
    assert mixing.mix(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 0.5, 1, {}).collect()}
    assert got == {"s1": 10, "s2": 492, "s3": 502}


def test_pipeline_stages(spark, docs, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "personal_data", "source_mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, "")
        assert out.columns == (["doc_id", "n_ids", "ids", "decoded_sha256"] if name == "sentencepiece" else docs.columns)
        assert stage(spark, none, "").count() == 0
    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert near == {i for i, (_, c) in brute_components([(r[0], r[1]) for r in DOCS], 5, 80, 100).items() if c == i}


def test_stages_with_null_ids_and_clashing_names(spark, docs):
    lost = [(None, "mail a@b.cc now", "en", None, 5, "c", 1), (None, None, None, None, None, None, None), (None, BASE, "en", "src0", None, "c", 1)]
    names = ("spans", "text_key", "own", "chosen_id", "component_id", "base", "pii_spans", "lang_pred")
    more = docs.unionByName(spark.createDataFrame(lost, SCHEMA)).select("*", *(F.lit(n).alias(n) for n in names))
    found = {"near": corpus_pipeline.near_duplicates(spark, more, ""), "pii": corpus_pipeline.personal_data(spark, more, "")}
    found["mix"] = corpus_pipeline.source_mixing(spark, more, "")
    rows = {k: df.collect() for k, df in found.items()}
    for k, df in found.items():
        assert df.columns == more.columns
        assert all(r[n] == n for r in rows[k] for n in names)
    assert sorted(r.text or "" for r in rows["near"] if r.doc_id is None) == sorted(t or "" for _, t, *_ in lost if t != BASE)
    assert sorted((r.text or "", r.n_chars) for r in rows["pii"] if r.doc_id is None and r.text != BASE) == [("", None), ("mail [EMAIL] now", 16)]
    assert len(rows["pii"]) == len(DOCS) + len(lost)
    assert {r.doc_id for r in mixing.mix(more, max_epochs=1).collect()} == {r.doc_id for r in rows["mix"]}


def test_language_stage(spark, none):
    own = {"aa": "kalimba tarika molano ", "bb": "strüngst pfläch dwörk "}
    rows = [(i, own[k] * 3, k, None, None, "x", 1) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    rows += [(None, own["aa"] * 4, "aa", None, None, "x", 1), (900, None, "aa", None, None, "x", 1), (901, "12 34", "bb", None, None, "x", 1)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == none.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0)] + [(True, i) for i in range(60)]
    assert corpus_pipeline.language_id(spark, none, "").count() == 0
