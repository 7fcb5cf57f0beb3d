"""The operators against plain versions where SQL can't express them, and in the cases that are hard for each."""

import collections
import hashlib
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import archives, chat, common, jaccard, langid, media, mixing, neighbours, pieces, pii, substrings

from .test_operators import BASE, SCHEMA, TEXTS, brute_components, brute_spans, prose

LANGUAGES = {"aa": "kalimba tarika molano sefu", "bb": "strüngst pfläch dwörk grozn"}


def alternating(n, a="a", b="b"):
    """The Thue-Morse word of n letters."""
    while len(a) < n:
        a, b = a + b, b + a
    return a


def plain_feature(payload):
    """Peak pairs by loops over frames, bands and peaks."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = 1 + max(0, -(-(len(x) - media.FRAME) // media.HOP))
    x = np.concatenate([x, np.zeros(media.FRAME + (n - 1) * media.HOP - len(x), np.float32)])
    level, best = {}, {}
    for t in range(n):
        size = np.rint(np.abs(np.fft.rfft(x[t * media.HOP : t * media.HOP + media.FRAME] * media._HANN)))
        for k, (low, high) in enumerate(media.BANDS):
            best[t, k] = low + max(range(high - low), key=lambda i: (size[low + i], -i))
            level[t, k] = size[best[t, k]]
    peaks = [(t, best[t, k]) for t in range(n) for k in range(len(media.BANDS)) if level[t, k] > 0 and level[t, k] >= level.get((t - 1, k), 0) and level[t, k] > level.get((t + 1, k), 0)]
    return sorted(t << 32 | f << 16 | peaks[j][1] << 8 | (peaks[j][0] - t) for i, (t, f) in enumerate(peaks) for j in range(i + 1, min(i + 4, len(peaks))) if peaks[j][0] - t <= media.REACH)


def test_media_feature_and_stored_form(spark):
    texts = [None, "", BASE, prose(400), "aé" * 3000, prose(5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = media.read_media(media.write_media(df)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        payload = media.pad((texts[r.doc_id] or "").encode())
        assert r.fingerprint == plain_feature(payload)
        stored = media.to_wav(payload)
        assert stored[44:] == payload and stored[:4] == b"RIFF"  # the header of 44 bytes, then one byte a sample
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_in_blocks(monkeypatch):
    samples = np.frombuffer(media.pad(prose(2000).encode()), np.uint8)
    want = media.fingerprint(samples).tolist()
    monkeypatch.setattr(media, "_BLOCK", 7)
    assert media.fingerprint(samples).tolist() == want


def test_chat_of_a_very_long_text(spark):
    said = "\\### </turn> \n</turn>\n### x\n " * 20_000
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)] * 2, "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [t.text for t in row.turns] == [said] * 4 and row.loss == said * 2


def plain_language(net, text):
    """Mean probabilities by one pass over each window, in double precision."""
    data, total, h = text.encode(), np.zeros(len(net.names)), net.u.shape[3]
    table, u = net.table.astype(float), net.u.astype(float)
    for a in range(0, len(data), langid.WINDOW):
        window = data[a : a + langid.WINDOW].ljust(langid.WINDOW)
        states = np.zeros((langid.WINDOW, 2 * h))
        for side in (0, 1):
            state = np.zeros(h)
            for step in range(langid.WINDOW):
                t = step if side == 0 else langid.WINDOW - 1 - step
                x = table[:, side, window[t]]
                z, r = (np.clip((x[k] + state @ u[k, side]) / 4 + 0.5, 0, 1) for k in (0, 1))
                new = x[2] + r * (state @ u[2, side])
                new = new / (1 + abs(new))
                state = z * (state - new) + new
                states[t, side * h : (side + 1) * h] = state
        scores = np.exp(states @ net.v + net.c)
        total += (scores / scores.sum(axis=1, keepdims=True))[: len(data) - a].sum(axis=0)
    return total / len(data)


def language_rows(n=60):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(LANGUAGES[k].split(), 12)), k) for i, k in enumerate(["aa", "bb"] * (n // 2))]


def test_language_by_a_plain_pass(spark):
    net = langid.train([(t.encode(), k) for _, t, k in language_rows()], steps=80)
    texts = ["k", "kalimba " * 16, "strüngst pfläch " * 90, "kalimba dwörk " * 30, "x" * 128, "é" * 64 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = langid.predict(df, net).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        p = plain_language(net, texts[r.doc_id])
        assert r.lang_pred == net.names[p.argmax()] and abs(r.score - p.max()) < 1e-4
    flat = langid.Network(net.table * 0, net.u * 0, net.v * 0, net.c * 0, net.names)
    tied = langid.predict(df, flat).first()
    assert (tied.lang_pred, round(tied.score, 6)) == ("aa", 0.5)


def test_language_of_texts_that_were_not_learnt(spark):
    rows = [(100 + i, t, k) for i, t, k in language_rows(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(df, net).join(df.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id")))
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 50


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_WINDOWS", 150)
    df = spark.createDataFrame([(f"word{i} text {k}", f"l{k:03}") for k in range(100) for i in range(3)], "text string, lang string")
    assert collections.Counter(k for _, k in langid.sample(df)) == {f"l{k:03}": 1 for k in range(100)}
    monkeypatch.setattr(langid, "MOST_WINDOWS", 99)
    with pytest.raises(ValueError):
        langid.sample(df)


@pytest.mark.parametrize("unit", ["a", "=", "-", "_", "*", " ", "q", "ab ", "é", "\U0001f600", "▁"])
def test_pieces_of_long_runs(unit):
    vocab = pieces.load()
    encoder = pieces.Encoder(vocab)
    text = (unit * 3000)[:3000]
    own = frozenset(i + 1 for i, c in enumerate(text) if c == pieces.MARK)
    marked = pieces.MARK + text.replace(" ", pieces.MARK)
    ids = np.frombuffer(encoder.encode(text), np.int32)
    if not own:
        assert ids.tolist() == plain_ids(vocab, marked)
    assert pieces.Decoder(vocab).decode(ids, np.array([0, len(ids)])) == [text]


def plain_ids(vocab, marked):
    """The best path over the whole text by back pointers alone; of equal ones that with the longer last piece."""
    best, back = [0.0] + [-1e300] * len(marked), [(0, 0)] * (len(marked) + 1)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - vocab.longest), end):
            known = vocab.pieces.get(marked[start:end], (-1, vocab.unknown_score) if end == start + 1 else None)
            if known and best[start] + known[1] > best[end]:
                best[end], back[end] = best[start] + known[1], (start, known[0])
    out, at = [], len(marked)
    while at:
        start, piece = back[at]
        out.append([piece] if piece >= 0 else [vocab.byte_ids[b] for b in marked[start].encode()])
        at = start
    return [x for own in reversed(out) for x in own]


def test_pieces_in_time_that_grows_with_the_text():
    import time

    encoder = pieces.Encoder(pieces.load())
    took = []
    for n in (20_000, 200_000):
        start = time.process_time()
        for unit in "a=- ":
            encoder.encode(unit * n)
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.02)


def test_substrings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3_000)
    lines = [prose(12) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"{prose(9)} {lines[i % 6]} {lines[0]} {prose(7)}") for i in range(40)] + [(104, "other " + lines[2]), (103, TEXTS[3])]
    got = collections.Counter(tuple(r)[1:5] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = []
    for i, t in rows:  # rows with one id don't count against each other
        seen = {b[k : k + 50] for j, u in rows if j < i and (b := (u or "").encode()) for k in range(len(b) - 49)}
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    assert got == collections.Counter(want)


def test_substrings_without_an_id_come_first(spark):
    df = spark.createDataFrame([(None, BASE, 1), (1, BASE, 1), (1, BASE, 1)], "doc_id long, text string, bucket int")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()) == [(-(1 << 63), 0), (1, len(BASE)), (1, len(BASE))]


def test_suffixes_with_hashes_that_collide(monkeypatch):
    rng = np.random.default_rng(2)
    before = [bytes(rng.integers(97, 99, rng.integers(0, 31)).astype(np.uint8)) for _ in range(400)]
    behind = [bytes(rng.integers(97, 98 + (i % 2), rng.integers(20, 51)).astype(np.uint8)) for i in range(400)]
    ids, anchors = rng.integers(0, 90, 400), np.zeros(400, np.int64)

    def brute():
        owner = {}
        for b, s, i in zip(before, behind, ids, strict=True):
            for j in range(31):
                if len(b) >= j and len(s) >= 50 - j:
                    key = (j, b[len(b) - j :] + s[: 50 - j])
                    owner[key] = min(owner.get(key, i), i)
        return [sum(1 << j for j in range(31) if len(b) >= j and len(s) >= 50 - j and owner[j, b[len(b) - j :] + s[: 50 - j]] < i) for b, s, i in zip(before, behind, ids, strict=True)]

    want = brute()
    assert any(want) and substrings.smallest_owner(before, behind, ids, anchors).tolist() == want
    exact = substrings.between
    monkeypatch.setattr(substrings, "between", lambda p, a, b: exact(p, a, b) & np.uint64(3))
    assert substrings.smallest_owner(before, behind, ids, anchors).tolist() == want


def test_neighbours_by_pruned_lists(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 12)) * 2
    v = centers[rng.integers(0, 60, 10_000)] + rng.normal(size=(10_000, 12)) * 0.4
    v[9000:] = v[0]  # one vector that many rows share
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).withColumn("ids", F.lit(1))
    asks = F.col("vec_id") % 100 == 0
    found, sure = ({(r.query_id, r["rank"]): r for r in neighbours.search(df, asks, exact=e).collect()} for e in (False, True))
    hits = 0
    for q in range(0, 10_000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(v)), d))[:10].tolist()
        assert [sure[q, k].vec_id for k in range(1, 11)] == want
        hits += len({found[q, k].vec_id for k in range(1, 11)} & set(want))
        assert all(abs(found[q, k].score - d[found[q, k].vec_id]) < 1e-12 for k in range(1, 11))
    assert hits >= 0.9 * 1000
    unique = np.unique(v, axis=0)
    lists = int(np.ceil(2 * np.sqrt(len(unique))))
    index = neighbours.fit(unique[rng.permutation(len(unique))[: 32 * lists]], lists)
    visited = np.mean([len(index.within(x, index.ratio, index.usual)[0]) for x in v[::100]])
    assert len(index.points) == lists > 180 and visited < 0.5 * lists


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(0, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 4.0]), (2, [0.0, 4.0]), (100, [0.0, 9.0]), (100, [5.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0] == [(1, 1.0), (2, 3.0), (100, 5.0)]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 100] == [(1, 1.0), (0, 5.0), (2, 5.0)]


#: Two archives as other writers left them: line feeds alone in HTTP headers, a content type and a URL with spaces, no HTTP.
FOREIGN = [
    b"filedesc://IA-001102.arc 0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://www.dryswamp.com:80/index.html 127.10.100.2 19961104142103 text/html 66\nHTTP/1.0 200 Document follows\nContent-type: text/html\n\nHello swamp\n"
    b"http://a.example/b c 127.0.0.1 19961104142104 text/html; charset=x 4\nabcd\n\n"
    b"dns:a.example 127.0.0.1 00000000000000 text/dns 5\n12345\n",
    b"filedesc://IA-2.arc 0 19960923142103 text/plain 200 - - 0 IA-2.arc 121\n2 0 Alexa Internet\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    + b"\n" * 3 + b"http://www.dryswamp.com:80/index.html 127.10.100.2 19961104142103 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 IA-2.arc 20\nHTTP/1.0 200 OK\n\nyes\n",
]


def test_archives_of_other_writers(spark):
    df = spark.createDataFrame([("IA-001102.arc", bytearray(FOREIGN[0])), ("IA-2.arc", bytearray(FOREIGN[1]))], "name string, content binary")
    warcs = archives.convert(df)
    records = {r.url: r for r in archives.read_warc(warcs).collect()}
    assert {u: (r.warc_type, r.payload_bytes) for u, r in records.items() if "swamp" not in u} == {"http://a.example/b c": ("resource", 4), "dns:a.example": ("resource", 5)}
    fields = {f["WARC-Target-URI"]: f for w in warcs.collect() for f, _ in archives.parse_warc(bytes(w.content))}
    assert fields["http://a.example/b c"]["Content-Type"] == "text/html; charset=x" and fields["http://a.example/b c"]["WARC-Date"] == "1996-11-04T14:21:04Z"
    assert fields["dns:a.example"]["WARC-Date"] == "1970-01-01T00:00:00Z" and fields["dns:a.example"]["WARC-IP-Address"] == "127.0.0.1"
    both = [r for w in warcs.collect() for r in archives.parse_warc(bytes(w.content)) if "swamp" in r[0]["WARC-Target-URI"]]
    assert sorted(archives.split_http(b)[1] for _, b in both) == [b"Hello swamp", b"yes"]


def test_archives_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(1, "u", "x" * 150)] * 3 + [(i, f"u{i}", "x" * 150) for i in range(2, 30)] + [(None, None, None)] * 2
    warcs = archives.convert(archives.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)))
    got = archives.read_warc(warcs).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert collections.Counter((r.warc_type, r.refers_to) for r in got) == {("response", None): 5, ("revisit", 1): 28}
    heads = {f["WARC-Record-ID"]: f for w in warcs.collect() for f, _ in archives.parse_warc(bytes(w.content))}
    assert all(heads[f["WARC-Refers-To"]]["WARC-Type"] == "response" for f in heads.values() if "WARC-Refers-To" in f)


def brute_added(texts, support=pii.MIN_SUPPORT, confidence=pii.MIN_CONFIDENCE):
    """Spans of kind id by loops over words, patterns and rounds."""
    seen = []  # (text, start, end, value, seed, patterns)
    for no, text in enumerate(texts):
        text = text or ""
        base = brute_spans(text)
        runs, last = [], None
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if not re.search("[0-9]", m[0]):
                last = None
                continue
            lead = len(regex.match(r"[^\p{L}0-9]*", m[0])[0])
            start = m.start() + lead
            end = start + len(regex.sub(r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "", m[0]))
            if any(s < end and start < e for s, _, e in base):
                last = None
                continue
            if last is None:
                runs.append([])
            runs[-1].append((start, end))
            last = end
        own = [(s, e, True) for s, _, e in base]
        for run in runs:
            own += [(run[0][0], run[-1][1], False)] + [(s, e, False) for s, e in run[1:]]
        for s, e, seed in own:
            words = text[max(0, s - pii.CONTEXT) : s].lower().split()
            patterns = [" ".join(words[-2:])] if len(words) > 1 else []
            patterns += [words[-1]] if words and regex.search(r"[\p{L}0-9][:=#]+$", words[-1]) else []
            seen.append((no, s, e, text[s:e].lower(), seed, patterns))
    edges, seeds = {(p, v) for *_, v, _, ps in seen for p in ps}, {v for *_, v, seed, _ in seen if seed}
    trusted, conf = set(), {}
    while True:
        score = collections.defaultdict(float, {v: 1.0 for v in seeds})
        for p, v in edges:
            if p in trusted and v not in seeds:
                score[v] = max(score[v], conf[p])
        by = collections.defaultdict(list)
        for p, v in edges:
            by[p].append(score[v])
        conf = {p: sum(x) / len(x) for p, x in by.items()}
        now = {p for p, x in by.items() if sum(x) >= support - 1e-9 and conf[p] >= confidence - 1e-9}
        if len(now) == len(trusted):
            break
        trusted = now
    found = [{(s, e) for t, s, e, _, seed, ps in seen if t == no and not seed and trusted & set(ps)} for no in range(len(texts))]
    return [sorted((s, e) for s, e in own if not any((a, b) != (s, e) and a <= s and e <= b for a, b in own)) for own in found]


def planted(n=240):
    """Texts with identifiers in contexts that personal data also stands in, and numbers in contexts of their own; where the first are."""
    rng, texts, true = np.random.default_rng(6), [], set()
    for i in range(n):
        kind = i % 12
        lead = " ".join(rng.choice(["blue", "river", "seven", "walks", "cloud"], 4))
        contact = [f"p{i}@mail{i}.example", f"+49 30 {1000000 + 37 * i}"][i // 2 % 2]
        if kind < 8:
            texts.append(f"{lead} {['account holder', 'ref:'][kind % 2]} {contact} today")
        elif kind < 10:
            value = [f"AB-{i}77", f"7{i} x5{i} 9{i}"][i // 12 % 2]
            texts.append(f"{lead} {['account holder', 'ref:'][kind - 8]} {value} today")
            true.add((i, texts[-1].index(value), texts[-1].index(value) + len(value)))
        else:
            texts.append(f"{lead} {['page number', 'in year'][kind - 10]} {1900 + i} today, {'account holder none' if i % 24 == 10 else 'nothing'}")
    return texts, true


def test_personal_data_by_brute_force(spark):
    texts, true = planted()
    texts += [None, "", "x1 " * 4000, "account holder", "ref: 12, 34; a@b.cc 56 78", "ref: AB1 ref: AB1", "write to 5éx \U0001f600 write to 77"]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in pii.find_personal_data(df).collect():
        got[r.doc_id].append([(s.start, s.end) for s in r.added])
    assert [got[i][0] for i in range(len(texts))] == brute_added(texts)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    found = {(i, *s) for i in range(240) for s in got[i][0]}
    assert found == true  # precision and recall of 1 where contexts repeat


def test_personal_data_of_a_long_text_is_linear(spark):
    texts = ["id 1234567 " * 12_000, "a@b.cc 12 " * 8_000, "+1 (988) 555-2485 x7 " * 4_000]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert [tuple(s) for s in r.base] == brute_spans(t)
    red = spark.createDataFrame([(texts[1],)], "t string").select(pii.redact(F.col("t"), pii.base_spans(F.col("t")))).first()[0]
    assert red == "[EMAIL] 12 " * 8_000


def row_components(texts, k, num):
    return [c for _, c in brute_components(list(enumerate(texts)), k, num, 100).values()]


def test_words_that_a_polynomial_confuses(spark):
    for n in (1024, 2048):
        rows = [(1, alternating(n)), (2, alternating(n, "b", "a")), (3, "x"), (4, alternating(n).upper())]
        got = {r.doc_id: (r.n_shingles, r.class_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: (1, 1, 1), 2: (1, 2, 2), 3: (1, 3, 3), 4: (1, 1, 1)}


def test_similarity_on_words():
    rng = np.random.default_rng(8)
    for _ in range(400):
        k = int(rng.integers(4, 6))
        a, b = ([bytes([97 + c]) for c in rng.integers(0, 2, rng.integers(0, 14))] for _ in range(2))
        x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for w in (a, b))
        both, either = jaccard.similarity(a, b, k)
        assert both == len(x & y) and (either == len(x | y) or not both)


def test_jaccard_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)  # every key that two rows share is dealt out
    near = [BASE + f" tail{i}" for i in range(9)]
    rows = [(5, BASE), (5, prose(40)), (5, BASE), (None, BASE + " x"), (None, None), (2, None), (7, ""), *((10 + i, t) for i, t in enumerate(near)), (3, prose(50)), (3, prose(50))]
    rows = [(i, t, "clash", 1) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, node int").repartition(3)
    got = jaccard.jaccard_components(df).collect()
    want = row_components([t for _, t, *_ in rows], 5, 80)
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for at, c in enumerate(want):
        groups[c].append(at)
    ids = collections.Counter()
    for own in groups.values():
        least = min((rows[a][0] for a in own if rows[a][0] is not None), default=None)
        ids += collections.Counter((rows[a][0], least) for a in own)
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == ids
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert len(kept) == len(groups)
    assert {(r.doc_id, r.text) for r in kept} == {min(((rows[a][0] is None, rows[a][0] or 0), rows[a][:2]) for a in own)[1] if len({rows[a][0] for a in own}) > 1 else rows[own[0]][:2] for own in groups.values()}


def test_all_links_of_the_join(spark):
    rng, words = np.random.default_rng(9), BASE.split()
    texts = [" ".join(w if rng.random() > 0.03 else "new" + str(rng.integers(9)) for w in words) for _ in range(90)] + [BASE, BASE, None, "a b"]
    links, rows = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 70)
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} - {()}) for w in ((t or "").split() for t in texts)]
    near = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])
    classes = {t: i for i, t in reversed(list(enumerate(texts))) if t}
    want = {i: sum(near(i, j) for t, j in classes.items() if t != texts[i]) if texts[i] else 0 for i in range(len(texts))}
    assert {r.doc_id: r.n_links for r in rows.collect()} == want and links.count() == sum(want[j] for j in classes.values()) / 2 > 90


def test_mixing_of_repeated_rows_and_short_leaves(spark):
    rows = [(i, "one two", "en", "web1", None, "", 1) for i in range(40)] * 2 + [(i, "three", "de", "book.2", None, "", 1) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = mixing.mix(df, fraction=2.0, max_epochs=2).collect()  # every leaf is short: all is given twice
    assert {r.epochs for r in whole} == {2} and len(whole) == len(rows) and {r.domain for r in whole} == {"web", "book"}
    half = collections.Counter((r.doc_id, r.source) for r in mixing.mixed_rows(df).collect())
    assert half == collections.Counter((r.doc_id, r.source) for r in mixing.mix(df, max_epochs=1).collect())
    assert all(n == 2 for (_, s), n in half.items() if s == "web1")
    assert sum(len(dict(enumerate(rows))[0][1].split()) for _ in half) <= sum(len(t.split()) for _, t, *_ in rows)


def brute_mix(rows, fraction, weights):
    """Rows drawn in at most one epoch, by filling the tree level by level; rows: (doc_id, text, lang, source)."""
    name = lambda s: re.match("^[^0-9./:_-]*", s)[0] or "?"
    size = lambda r: len((r[1] or "").split())
    leaf = lambda r: (name(r[3] or "?"), r[2] or "?", r[3] or "?")
    tokens = collections.Counter()
    for r in rows:
        tokens[leaf(r)] += size(r)
    given = {(): float(int(sum(tokens.values()) * fraction))}
    for depth in range(3):
        caps = collections.Counter()
        for path, n in tokens.items():
            caps[path[: depth + 1]] += n
        for parent in {p[:depth] for p in caps}:
            kin, left = {p: weights.get(p[-1], 1) if depth == 1 else 1 for p in caps if p[:depth] == parent}, given[parent]
            for p in sorted(kin, key=lambda p: (caps[p] / kin[p], p[-1])):
                weight = sum(kin.values())
                if caps[p] * weight <= kin[p] * left:
                    given[p] = float(caps[p])
                    left -= caps[p]
                    del kin[p]
            for p in kin:
                given[p] = kin[p] * left / sum(kin.values())
    out = []
    for path, n in tokens.items():
        budget = int(given[path])
        full = budget // n if n else 0
        rest = budget - full * n
        key = lambda r: hashlib.md5(f"{mixing.SEED}:{full + 1}:{r[0]}".replace(":None", "").encode()).hexdigest()  # noqa: B023, E731
        own = sorted((r for r in rows if leaf(r) == path), key=key)
        total = 0
        while own:
            peers = [r for r in own if key(r) == key(own[0])]
            total += sum(map(size, peers))
            if total <= rest or full:
                out += peers
            own = own[len(peers) :]
    return out


def test_pipeline_from_end_to_end(spark, tmp_path):
    words = {k: v.split() for k, v in LANGUAGES.items()}
    rng = np.random.default_rng(11)
    say = lambda k, n: " ".join("".join(rng.choice(words[k], 2)) for _ in range(n))
    rows = []
    for i in range(80):
        k = "ab"[i % 2] * 2
        rows.append((i, say(k, 25), k if i % 5 else None, f"web{i % 3}", None))
    rows += [(200 + i, rows[i][1] + " more", "aa", "web1", None) for i in range(0, 30, 3)]
    rows += [(300, say("aa", 9) + " mail p1@host.example 4111 1111 1111 1111", "aa", "book1", 5), (300, say("bb", 20), "bb", "book1", 5)]
    rows += [(301, None, "aa", "web1", None), (302, "12 34", "aa", None, None), (None, say("aa", 22), None, None, 7), rows[4], rows[7]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id is None, r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    net = langid.fit(spark.createDataFrame(rows, kinds).filter(~langid.held_out(F.col("doc_id"))))
    told = [r for r in rows if r[1] and re.search("[a-z]", r[1]) and plain_language(net, r[1]).max() >= 0.5 + 0.5 * corpus_pipeline.LEAST_SHARE]
    assert len(told) > 80
    groups = collections.defaultdict(list)
    for r, c in zip(told, row_components([r[1] for r in told], 5, 80), strict=True):
        groups[c].append(r)
    single = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]
    added, clean = brute_added([r[1] for r in single]), []
    for r, more in zip(single, added, strict=True):
        text, at, out = r[1], 0, ""
        for s, no, e in sorted([*brute_spans(text), *((s, 4, e) for s, e in more)]):
            if s >= at:
                out += text[at:s] + "[" + (*pii.KINDS, "id")[no].upper() + "]"
            at = max(at, e)
        clean.append((r[0], out + text[at:], r[2], r[3]))
    assert any("[EMAIL] [CARD]" in r[1] for r in clean)
    vocab, want = pieces.load(), []
    for r in brute_mix(clean, mixing.FRACTION, mixing.LANGUAGE_WEIGHTS):
        want.append((r[0] is None, r[0], plain_ids(vocab, pieces.MARK + r[1].replace(" ", pieces.MARK)), hashlib.sha256(r[1].encode()).hexdigest()))
    assert got == sorted(want, key=str) and 20 < len(got) < len(clean)
