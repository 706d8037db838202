"""Operators on texts, against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import iblt, langid, packing, pii, quality, simhash, suffixes, warc
from feedlake.llm.common import durable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(n, t, "en", None, None) for n, t in enumerate(texts)], DOCS)


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(50)) for k in rng.integers(0, 10, n))


# -- language -------------------------------------------------------------------------------------


def test_language(spark):
    english, german = "the house and the garden with that tree", "das haus und der garten mit diesem baum"
    model = langid.KneserNey.fit({"en": [english] * 3, "de": [german] * 3})
    model.calibrate([english, german], ["en", "de"])
    docs = spark.createDataFrame([(1, "The tree and the house"), (2, "der baum und das haus"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[3]["rejected"]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert model.decide(model.score_texts(["\u00b2 \u00bd 7"]), 8.0)[0][0] == "und"


def test_language_sample_counts_copies_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid.KneserNey, "fit", classmethod(lambda cls, texts, order: seen.update(texts) or seen))
    docs = frame(spark, ["the same words"] * 300 + [prose(n, 5) for n in range(30)])
    with pytest.raises(AttributeError):  # what stands in for the model can't be calibrated
        langid.fit(docs, F.lit(True))
    assert seen["en"].count("the same words") <= 1 and 1 <= len(seen["en"]) <= 31


def test_kneser_ney_prefers_what_it_has_seen():
    model = langid.KneserNey.fit({"x": ["abab aba bab abba"]}, order=3)
    assert len(model.keys) == 3
    score = model.word_scores(["ab", "zz"])
    assert score[0, 0] > score[1, 0] and score[0, 1] == 3


# -- personal data --------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub(r"\D", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(1)
    pieces = ["a@b.c", "@", ".", "1", "255", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", "-", " ", "x", "é", "1.2.3.4", "..", "user.name@mail.example.com", "+", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john [at] example (dot) com today", "email", "john [at] example (dot) com"),
        ("mail jane dot doe at example dot org now", "email", None),
        ("ip １９２.168.0.1 here", "ip", "１９２.168.0.1"),
        ("mаry@example.com", "email", None),
        ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ],
)
def test_disguises(text, kind, span):
    base, spans = pii.all_spans(text)
    assert set(base) <= set(spans)
    got = [text[a:b] for k, a, b in spans if k == kind]
    assert got and (span is None or span in got)


@pytest.mark.parametrize(
    ("text", "kind", "span", "base"),
    [
        ("mаry@example.com", "email", "mаry@example.com", "ry@example.com"),
        ("to anna.sсhmidt@example.com now", "email", "anna.sсhmidt@example.com", "hmidt@example.com"),
        ("at 10.20.30.4２ here", "ip", "10.20.30.4２", "10.20.30.4"),
        ("x@mail.exаmple.com", "email", "x@mail.exаmple.com", "x@mail.ex"),
        ("mail jane dot doe at example dot org now", "email", "jane dot doe at example dot org", None),
        ("mail jane dot doe@example.org now", "email", "jane dot doe@example.org", "doe@example.org"),
        ("call PLUS 4 nine 1 five 1 two 3 four 5 six 7 eight", "phone", "PLUS 4 nine 1 five 1 two 3 four 5 six 7 eight", None),
    ],
)
def test_disguises_in_full(text, kind, span, base):
    found, spans = pii.all_spans(text)
    assert [text[a:b] for _, a, b in found] == ([base] if base else [])
    assert (kind, text.index(span), text.index(span) + len(span)) in spans and set(found) <= set(spans)
    assert pii.redact(text, spans) == text.replace(span, f"<{kind.upper()}>")


def test_clean_texts_and_redaction(spark):
    assert pii.all_spans("Look at that dot matrix; one two three four. They sat at noon.") == ([], [])
    found = pii.find(frame(spark, ["a@b.co and 1.2.3.4", None, ""]), redacted=True).orderBy("doc_id").collect()
    assert [r["redacted"] for r in found] == ["<EMAIL> and <IP>", None, ""] and found[0]["spans"] == "email:0:6,ip:11:18"


# -- packing --------------------------------------------------------------------------------------


def test_chunked_tokens_equal_whole_ones():
    tokens = packing.Tokens(packing.default_tokenizer())
    hard = ["a  b", " lead", "trail ", "x\n \ny", "a \n\nb", " \n", "<|endoftext|> hi", "it's  don't", "a  b", "漢字 かな", "a\t b", "", "a" * 300, prose(1, 300)]
    for text, data in zip(hard, tokens.of(hard), strict=True):
        assert tokens.encode(text, add_special_tokens=False).ids == np.frombuffer(data, "<u4").tolist()


def test_packing(spark):
    docs = frame(spark, [prose(n, n * 13) for n in range(60)] + [None, "", prose(99, 3000)])
    packed = packing.pack(docs, packing.default_tokenizer(), with_ids=True)
    rows = packed.collect()
    tokens = packing.Tokens(packing.default_tokenizer())
    for r in docs.collect():
        whole = np.frombuffer(tokens.of([r["text"]])[0], "<u4").tolist() + [2]
        own = sorted((x for x in rows if x["doc_id"] == r["doc_id"]), key=lambda x: x["piece"])
        assert [i for x in own for i in x["ids"]] == whole
        assert all(x["length"] == 1024 for x in own[1:]) and [x["start"] for x in own] == [a for a, _ in packing.cuts(len(whole), 1024)]
        assert all(zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] for x in own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0
    assert {len(r["ids"]) for r in packing.sequences(packed).collect()} == {sum(n for _, n in p) for p in by.values()}


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 400))
        plan = packing.Plan(dict(Counter(sizes.tolist())), 100)
        rank = np.zeros(len(sizes), int)
        for s in set(sizes.tolist()):
            rank[sizes == s] = np.arange((sizes == s).sum())
        sequence, offset = plan.place(sizes, rank)
        used = np.zeros((plan.sequences, 100), int)
        for n, s, o in zip(sizes, sequence, offset, strict=True):
            used[s, o : o + n] += 1
        assert used.max() == 1 and plan.sequences <= -(-sizes.sum() // 100) * 1.25 + 1


# -- quality --------------------------------------------------------------------------------------


def test_quality():
    rng = np.random.default_rng(2)
    good = [prose(n, 60) for n in range(120)]
    bad = [" ".join(w + "&&&" for w in prose(n, 60).split()) if n % 2 else " ".join(["again"] * 60) for n in range(120)]
    texts, labels = good + bad, np.array([1] * 120 + [0] * 120)
    order = rng.permutation(240)
    train, held = order[:180], order[180:]
    model = quality.QualityModel().fit([texts[k] for k in train], labels[train])
    assert ((model.score([texts[k] for k in held]) >= 0.5) == labels[held]).mean() > 0.95
    assert all(0 <= s <= 1 for s in model.score([None, "", " "]))


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.QualityModel, "fit", lambda self, texts, labels: seen.append((texts, labels.tolist())) or self)
    docs = frame(spark, [f"text {n}" for n in range(60)] + [None]).union(spark.createDataFrame([(3, "a copy of an id", "en", None, None)] * 50, DOCS))
    labels = spark.createDataFrame([(n, n % 2) for n in range(61)] + [(3, 1)] * 40 + [(None, 1), (5, None)], "doc_id long, quality int")
    quality.fit(docs, labels, 3, 1, most_rows=20)
    quality.fit(docs, labels, 3, 1)
    (few, _), (texts, marks) = seen
    assert 19 <= len(few) <= 20 and len(set(texts)) == len(texts) and texts == sorted(texts)
    held = {n for n in range(61) if zlib.crc32(str(n).encode()) % 3 == 1}
    want = {n for n in range(60) if n not in held}
    assert len(texts) == len(want) and sum(marks) == sum(n % 2 for n in want)


# -- fingerprints ---------------------------------------------------------------------------------


def test_fingerprints(spark):
    lines = ["\n".join(f"line {k % 7} {n}" for k in range(n)) for n in range(40)]
    many = [f"long {k}" for k in range(400)]
    texts = [*lines, lines[5], None, "", "\n".join(many), "\n".join(many[:390] + ["new"])]
    rows = iblt.with_next(frame(spark, texts))
    follow = {r["doc_id"]: r["next_text"] for r in rows.collect()}
    plain = [t or "" for t in texts]
    assert [follow[k] for k in range(len(plain))] == plain[1:] + plain[:1]
    got = {r["doc_id"]: r for r in iblt.compare(frame(spark, texts)).collect()}
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(plain, plain[1:] + plain[:1], strict=True)]
    pairs = [(n, t, e, f) for n, (t, e, f) in enumerate(zip(plain, edited, plain[1:] + plain[:1], strict=True))]
    cut = spark.createDataFrame(pairs, "n int, a string, b string, c string").select("n", *(iblt.sentences(F.col(x)).alias(x) for x in "abc"))
    cut = durable(cut, "test-sentences")
    high = {x: F.greatest(iblt.level(F.col("a")), iblt.level(F.col(x))) for x in "bc"}
    sets = cut.select("n", *(iblt.paragraphs(F.col(x), high[y]).alias(f"{x}{y}") for x, y in ("ab", "bb", "ac", "cc")))
    shown = {r["n"]: (r["a"], r["b"]) for r in cut.select("n", iblt.paragraphs(F.col("a"), iblt.level(F.col("a"))).alias("a"), iblt.paragraphs(F.col("b"), iblt.level(F.col("b"))).alias("b")).collect()}
    for r in sets.collect():
        own = got[r["n"]]
        for name, x, y in (("near_edited", "ab", "bb"), ("near_next", "ac", "cc")):
            a, b = set(r[x]), set(r[y])
            assert own[name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert own["edited_sha256"] == hashlib.sha256(edited[r["n"]].encode()).hexdigest() and own["n_chars"] == len(plain[r["n"]])
        assert (unsketch(own["fingerprint"]), unsketch(own["edited_fingerprint"])) == tuple(set(x) for x in shown[r["n"]])
    assert got[5]["fingerprint"] == got[40]["fingerprint"] and got[41]["fingerprint"] == got[42]["fingerprint"] and got[41]["near_next"] == 1
    assert got[43]["near_next"] > 0.8
    assert iblt.compare(frame(spark, [])).count() == 0


def unsketch(text):
    """Digests in a returned fingerprint, peeled here."""
    third, data = text.split(":")
    third, data = int(third), base64.b64decode(data)
    cells = {}
    for k in range(0, len(data), 17):
        cells[int.from_bytes(data[k : k + 3])] = [int.from_bytes(data[k + 3 : k + 5]), int.from_bytes(data[k + 5 : k + 13], signed=True), int.from_bytes(data[k + 13 : k + 17])]
    found = set()
    where = {}
    for c, (_, k, _) in cells.items():
        where.setdefault(k, set()).add(c)
    while cells and (pure := [c for c, v in cells.items() if v[0] == 1]):
        _, key, check = cells[pure[0]]
        found.add(key)
        hit = [c for c in cells if c // third != pure[0] // third]
        spots = {c for c in SPOTS(key, third)}
        assert pure[0] in spots and spots - {pure[0]} <= set(hit)
        for c in spots:
            n, k, h = cells[c]
            cells[c] = [n - 1, k ^ key, h ^ check]
            if not any(cells[c]):
                del cells[c]
    assert not cells
    return found


def SPOTS(key, third):
    """Cells of a digest: the engine's hash, spelled out here."""
    return [xx64(key, iblt.SALT + j) % third + third * j for j in range(3)]


def xx64(key, number):
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = int_hash(number, h)
    return h - (1 << 64) if h >> 63 else h


def int_hash(number, seed):
    import struct

    import xxhash

    return xxhash.xxh64_intdigest(struct.pack("<i", number), seed)


def test_paragraphs_of_one_line(spark):
    said = [prose(n, 8) for n in range(12)]
    words = prose(40, 300)
    many = "".join(chr(0x4E00 + int(n)) for n in np.random.default_rng(41).integers(0, 3000, 400))
    whole = [s.join(said) for s in ("s. ", "é! ", "9? ", "。", "؟ ", "। ", ". ")] + [words, many]
    rows = spark.createDataFrame([(n, t, t[: 2 * len(t) // 3] + "q" * 9) for n, t in enumerate(whole)], "n int, a string, b string")
    rows = durable(rows.select("n", *(iblt.sentences(F.col(x)).alias(x) for x in "ab")), "test-sentences")
    high = F.greatest(iblt.level(F.col("a")), iblt.level(F.col("b")))
    for r in rows.select("n", *(iblt.paragraphs(F.col(x), high).alias(f"p{x}") for x in "ab")).collect():
        a, b = set(r["pa"]), set(r["pb"])
        assert len(a) >= 10 and len(b - a) <= 2 and len(a & b) >= 5, r["n"]


# -- suffixes -------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 3])
def test_suffix_dedup(spark, batches):
    shared, other = prose(7, 60), prose(8, 60)
    texts = [prose(n, 40) + shared + prose(n + 50, 30) for n in range(6)] + [other + "x" + other, "ab" * 300, "é" * 90 + shared, None, "", "short", shared, shared]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in suffixes.deduplicate(docs, 50, batches).collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 50] for d in data for i in range(len(d) - 49))
    for n, d in enumerate(data):
        mask = bytearray(len(d))
        for i in range(len(d) - 49):
            if seen[d[i : i + 50]] > 1:
                mask[i : i + 50] = b"\1" * 50
        want = ",".join(f"{m.start()}:{m.end()}" for m in re.finditer(rb"\x01+", bytes(mask)))
        assert got[n] == want


# -- near duplicates ------------------------------------------------------------------------------


def test_fingerprint_bits():
    import xxhash

    for text in (None, "", "One", "A b C", "a\tb\nc d  e f a b c d", prose(3, 200)):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % (1 << 64) == want


def test_links_and_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 3, 4, 5, 7))]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = simhash._forest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    for most in (4096, 3):
        edges = simhash.links(table, most=most)
        got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        label = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
        assert len({*zip(label, want.tolist(), strict=True)}) == len(set(label)) == len(set(want.tolist()))


def test_keep_one(spark):
    text = prose(1, 200)
    docs = frame(spark, [text, text, prose(2, 200), None, None]).union(spark.createDataFrame([(2, prose(2, 200), "en", None, None), (None, "x", None, None, None)], DOCS))
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(docs).collect())
    assert kept == [(False, 0), (False, 2), (False, 3), (True, 0)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# -- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    page = '<html lang="en"><head><title>A &amp; B</title><script>x="</p>"</script></head><body><!-- no --><p>One<br>two</p><a href="/x?a=1&amp;b=2">link</a></body></html>'
    source = warc.response(1, "http://h/ü", page)
    meta, text = warc.derivatives(source)
    assert text.block.decode() == "One\ntwo\nlink" and b"outlink: /x?a=1&b=2" in meta.block and b"title: A & B" in meta.block
    assert {r.get("WARC-Refers-To") for r in (meta, text)} == {source.get("WARC-Record-ID")}
    assert b"http-header-content-type: text/html" in meta.block and source.get("WARC-Payload-Digest").encode() in meta.block
    for packed in (True, False):
        (tmp_path / f"f{packed}.warc").write_bytes(warc.file_contents([source, meta, text], packed))
    back = warc.read(spark, str(tmp_path)).collect()
    assert Counter(r["record_type"] for r in back) == {"response": 2, "metadata": 2, "conversion": 2}
    assert {bytes(r["block"]) for r in back if r["record_type"] == "conversion"} == {text.block}
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain & <b>bold")], "page_id long, url string, html string")
    got = {(r["page_id"], r["record_type"]): r["content"] for r in warc.derive_pages(pages).collect()}
    assert len(got) == 6 and got[3, "conversion"] == "plain & bold" and got[1, "conversion"] == ""
    assert hashlib.sha1(text.block).digest() and warc.digest(text.block) == text.get("WARC-Block-Digest")


def test_warc_files_are_derived(spark, tmp_path):
    import gzip
    import zlib

    page = b"<p>caf\xe9 <b>au</b> lait<p>two"
    codings = {
        "plain": (page, []),
        "gzip": (gzip.compress(page), [("Content-Encoding", "gzip")]),
        "deflate": (zlib.compress(page), [("Content-Encoding", "deflate")]),
        "chunked": (b"5\r\n" + page[:5] + b"\r\n%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n", [("Transfer-Encoding", "chunked")]),
        "unknown": (page, [("Content-Encoding", "br")]),
        "image": (page, []),
    }
    made = []
    for name, (payload, extra) in codings.items():
        headers = [("Content-Type", "image/png" if name == "image" else "text/html; charset=latin-1"), *extra]
        block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + payload
        made.append(warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{name}>"), ("WARC-Date", "2020-02-02T00:00:00Z"), ("WARC-Target-URI", f"http://h/{name}")], block))
    made.append(warc.Record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x:ask>")], b"GET / HTTP/1.1\r\n\r\n"))
    (tmp_path / "a.warc.gz").write_bytes(warc.file_contents(made))
    (tmp_path / "b.warc").write_bytes(warc.file_contents(made[:1] * 2, False))
    got = warc.derive(warc.read(spark, str(tmp_path))).collect()
    texts = {r["refers_to"]: r["content"] for r in got if r["record_type"] == "conversion"}
    assert texts == {f"<urn:x:{n}>": "café au lait\ntwo" for n in ("plain", "gzip", "deflate", "chunked")}
    metas = {r["refers_to"]: r["content"] for r in got if r["record_type"] == "metadata"}
    assert set(metas) == {f"<urn:x:{n}>" for n in codings} and "http-header-content-type: text/html" in metas["<urn:x:gzip>"]
    assert len(got) == 10 + 4 and {r["record_date"] for r in got} == {"2020-02-02T00:00:00Z"}
    assert all("WARC-Concurrent-To" not in {f["name"] for f in r["fields"]} for r in got)
    for bad in (b"nonsense", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxx", b"WARC/1.1\r\nA: b\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.from_bytes(bad))


def test_malformed_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for piece in ("<p ", "<a ", "<title>", "<", "<!--", "<a href=\"", "&", "<script>", "</", "<p a='", "<head>", "<a href = "):
        warc.scan(piece * 300_000)
    assert time.perf_counter() - began < 12
    assert warc.scan("a < b <p title='x>y'>c<style>no</style><!-- no -->d &amp; e").text == "a < b\nc d & e"


class Visible(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """Another reading of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in (*warc.HIDDEN, "head")
        self.parts += ["\n"] * (tag in warc.BLOCKS) + [" "] * (tag in warc.HIDDEN)

    def handle_endtag(self, tag):
        self.hidden -= tag in (*warc.HIDDEN, "head")
        self.parts += ["\n"] * (tag in warc.BLOCKS)

    def handle_comment(self, data):
        self.parts.append(" ")

    def handle_data(self, data):
        self.parts.append("" if self.hidden else data.replace("\n", " "))


def test_every_page_equals_another_parser(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r["page_id"], r["record_type"]): r for r in warc.op3_warc_derivatives(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for p in pages:
        parser = Visible()
        parser.feed(p["html"] or "")
        parser.close()
        lines = [" ".join(x.split()) for x in "".join(parser.parts).split("\n")]
        text, meta = got[p["page_id"], "conversion"], got[p["page_id"], "metadata"]
        assert text["content"] == "\n".join(x for x in lines if x)
        assert text["refers_to"] == meta["refers_to"] and meta["content"].count("outlink:") == len(re.findall(r"<a\b[^>]*\bhref", p["html"] or ""))
        assert text["block_digest"] == warc.digest(text["content"].encode()) and text["target_uri"] == (p["url"] or "")
