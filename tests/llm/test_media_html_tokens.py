"""Transport streams, HTML text, SentencePiece and packing."""

import hashlib
import html
import random
import re
import time
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm import html_text, media_ts, packing, queries, sentence_pieces, textops

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500), st.integers(1, 800))
def test_stream_round_trip(data, times):
    payload = media_ts.payload_of(data * times)
    media = media_ts.mux(payload)
    got = media_ts.demux(media)
    assert got.payload == payload and len(media) % 188 == 0 and set(media[::188]) == {0x47}
    assert (got.sync_errors, got.table_errors, got.continuity_errors) == (0, 0, 0) and got.programs == {1: 0x1000} and got.streams == {0x100: 6}
    n = -(-len(payload) // media_ts.PES_BYTES)
    assert got.times == [k * media_ts.TICKS for k in range(n)] and got.access == got.times[:: media_ts.GROUP]


def test_every_stuffing_length():
    for n in range(1, 800):
        assert media_ts.demux(media_ts.mux(bytes([7]) * n)).payload == bytes([7]) * n


def test_damaged_stream():
    media = media_ts.mux(bytes(range(256)) * 40)
    lost = media_ts.demux(media[: 188 * 5] + media[188 * 6 :])
    assert lost.continuity_errors == 1 and lost.payload != media
    assert media_ts.demux(media[:20] + b"\0" + media[21:]).table_errors
    assert media_ts.demux(b"").payload == b"" and media_ts.demux(media + b"x").sync_errors == 1
    assert media_ts.stamp((1 << 33) - 1) == b"\x2f\xff\xff\xff\xff"
    assert media_ts.section_crc(b"123456789") == 0x0376E6E7


def packet(pid, counter, payload, unit=False, flags=None):
    """A packet built by hand: payload behind an adaptation field that fills what is left."""
    room = 184 - len(payload)
    head = bytes([0x47, 0x40 * unit | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15])
    field = b"" if not room else bytes([room - 1]) + (bytes([flags or 0]) + b"\xff" * (room - 2) if room > 1 else b"")
    return head + field + payload


def section(table, number, body):
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + media_ts.section_crc(head + body).to_bytes(4, "big")


def by_hand(streams=60, described=20, repeat=(), twice=(), gap=None):
    """A stream whose program map takes several packets; ``repeat`` and ``twice`` are packets that come two and three times, ``gap`` one after which the counter jumps, marked."""
    pat = section(0, 1, bytes([0, 0, 0xE0, 16, 0, 7, 0xF0, 0]))
    es = b"".join(bytes([6, 0xE1, k, 0xF0, described]) + b"d" * described for k in range(streams))
    pmt = section(2, 7, bytes([0xE1, 0, 0xF0, 0]) + es)
    out = [packet(0, 0, b"\0" + pat, True)]
    data, k = b"\0" + pmt + section(0x42, 9, b"another table"), 0
    while data:
        out.append(packet(0x1000, k, data[:184], k == 0))
        data, k = data[184:], k + 1
    payload = random.Random(3).randbytes(1000)
    pes = b"\0\0\1\xbd" + (len(payload) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + media_ts.stamp(9) + payload
    counter = 0
    for n, at in enumerate(range(0, len(pes), 150)):
        if gap == n:
            counter += 5
        own = packet(0x100, counter, pes[at : at + 150], n == 0, 0x80 if gap == n else 0x40 if n == 0 else 0)
        out += [own] * (1 + (n in repeat) + 2 * (n in twice))
        counter += 1
    return b"".join(out), payload, k


def test_tables_over_packets():
    media, payload, n = by_hand()
    got = media_ts.demux(media)
    assert n > 5 and got.programs == {7: 0x1000} and sorted(got.streams) == list(range(0x100, 0x100 + 60)) and got.streams[0x100] == 6
    assert got.payload == payload and got.access == got.times == [9] and got.continuity_errors == 0
    assert got.table_errors == 59  # streams that the map names and that have no packets
    cut = media_ts.demux(media[: 188 * 3] + media[188 * 4 :])
    assert not cut.streams and cut.table_errors


def test_repeats_and_discontinuities():
    for options, errors in (({}, 0), ({"repeat": (0, 2, 6)}, 0), ({"twice": (3,)}, 1), ({"gap": 4}, 0), ({"repeat": (1,), "gap": 2}, 0)):
        media, payload, _ = by_hand(streams=1, **options)
        got = media_ts.demux(media)
        assert got.continuity_errors == errors and (errors or got.payload == payload) and got.times == [9], options
    media, payload, _ = by_hand(streams=1)
    plain = media_ts.demux(media[:-188] + media[-188 * 2 : -188] + media[-188:])
    assert plain.payload == payload and plain.continuity_errors == 0
    twins = bytearray(media_ts.mux(b"\0" * 64_000))  # equal payloads with counters that go on are no repeats
    assert media_ts.demux(bytes(twins)).payload == b"\0" * 64_000


def test_clashing_names_in_media_and_pieces(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, payload_bytes string, n_pieces int")
    got = media_ts.digest(df).first()
    assert (got.payload_bytes, got.n_pieces, got.text) == (64, 5, "a b")
    own = sentence_pieces.digest(df, PIECES)
    assert len(own.columns) == len(set(own.columns)) == 3 + len(sentence_pieces.DIGEST) and own.schema["n_pieces"].dataType == sentence_pieces.DIGEST["n_pieces"].dataType
    assert own.first().payload_bytes == "x" and own.first().round_trip


def test_no_damage_is_fatal():
    r = random.Random(5)
    whole = [media_ts.mux(media_ts.payload_of(r.randbytes(n))) for n in (1, 500, 40_000)]
    for _ in range(4000):
        own = bytearray(r.choice(whole))
        for _ in range(r.randint(1, 6)):
            own[r.randrange(min(len(own), 188 * 4))] = r.choice([0, 0x47, 0xFF, 0xB7, 0x40, r.randrange(256)])
        if r.random() < 0.3:
            del own[: r.randrange(400)]
        assert isinstance(media_ts.demux(bytes(own)).feature(), str)
    media = bytearray(whole[1])
    media[188 * 2 + 1] &= 0xBF  # no unit begins
    assert media_ts.demux(bytes(media)).table_errors and not media_ts.demux(bytes(media)).payload
    media = bytearray(whole[1])
    media[188 + 3], media[188 + 4] = 0x30, 183  # an adaptation field that fills a table's packet
    assert media_ts.demux(bytes(media)).table_errors
    media = bytearray(whole[0])
    at = media.index(b"\0\0\1\xbd", 376)
    media[at + 8] = 255  # a header that is longer than its packet
    assert media_ts.demux(bytes(media)).table_errors
    spark_rows = [media_ts.demux(b) for b in (b"", b"G" * 188, b"\0" * 1000)]
    assert all(d.table_errors for d in spark_rows)


def test_op6(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    long_text = "ä" * 300_000
    rows = queries.op6_media_ts(spark, d).collect() + media_ts.digest(spark.createDataFrame([(-1, long_text)], "doc_id long, text string"), keep=["doc_id"]).collect()
    texts[-1] = long_text.encode()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        # sizes from the format: a unit of 32,768 bytes has a header of 14, every eighth one a clock of 8, and packets carry 184 bytes
        units = [min(32_768, len(payload) - at) + 14 + 8 * (at // 32_768 % 8 == 0) for at in range(0, len(payload), 32_768)]
        packets = 2 + sum(-(-u // 184) for u in units)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == 188 * packets and r.media_sha256 == hashlib.sha256(media_ts.mux(payload)).hexdigest()
        assert r.feature == f"packets={packets};streams=1;pes={len(units)};pts=0-{3600 * (len(units) - 1)};access={-(-len(units) // 8)};errors=0"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 50), (3, "é" * 50)], "doc_id long, text string")
    got = media_ts.digest(docs, keep=["doc_id"]).orderBy("doc_id").collect()
    assert got[0][1:] == got[1][1:] and got[2] == got[3] and got[0].payload_bytes == 64 and got[2].payload_bytes == 128
    assert got[0].tail_crc32 == zlib.crc32(bytes(64))
    back = media_ts.read(media_ts.store(docs), "media", ["doc_id"]).orderBy("doc_id").collect()
    assert bytes(back[2].payload) == media_ts.payload_of("é".encode() * 50) and back[2].pts == [0] and back[2].access_points == [0]
    assert media_ts.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p>a<p>b", "a\n\nb"), ("a <b>b</b>c  d\n e", "a bc d e"), ("<head><title>t</title><p>x", "x"), ("<script>var t='</p>';</script>x<style>p{}</style>", "x"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  3. c\n  4. d\n- e\n\nf"), ("<div hidden>a</div><div style='color:red; display: none'>b</div>c", "c"),
    ("<p style='visibility:hidden'>a<span style='visibility:visible'>b</span></p>", "b"), ("<!-- a -->&lt;b&gt;&amp;", "<b>&"), ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("<table><tr><th>n<th>count<tr><td>apples<td>3</table>", "n       count\napples  3"), ("<table><td>a<td>b<tr><td>c", "a  b\nc"), ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
    ("<svg><title>t</title><text>a</text><desc>d</desc></svg> <math><mi>x</mi><annotation>n</annotation></math> <object>o</object>", "a x o"), ("<p><button>a</p>b", "ab"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<details><summary>s</summary>hidden</details>", "s"), ("<select><option>1<option selected>2</select>", "2"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<h1>a</h1>b<hr>c", "a\n\nb\n\n---\n\nc"), ("</p>a</div></b>", "a"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"), ("<template>a</template><noscript>b</noscript>c", "c"), ("<blockquote>q</blockquote>", "> q"),
])
def test_html(page, text):
    assert html_text.render(page) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<tr>", "<b>", "</b>", "<div>", "</div>", "<pre>", "<ol>", "&amp;", "<br>", "<!--", "<", "x y", "\n", "<td colspan=9 rowspan=3>", "</td>", "<dd>", "<h1>", "<a href"]), max_size=30))
def test_html_never_fails(parts):
    assert isinstance(html_text.render("".join(parts)), str)


def test_html_keeps_every_visible_word(spark):
    rows = queries.op1_html_text(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 50
    for r in rows:
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script>.*?</script>|<[^>]*>", " ", r.html)
        assert re.sub(r"[^\w|]+", "", r.text.replace("\n- ", "\n")) == re.sub(r"[^\w|]+", "", html.unescape(body))


def test_hostile_pages():
    began = time.process_time()
    assert len(html_text.render("<blockquote>x" * 4000)) < 4000 * 200
    assert html_text.render("<p><button>" + "<i>" * 8000 + "</p>" * 8000 + "x") == "x"
    assert time.process_time() - began < 5


def test_html_deep_and_null(spark):
    assert html_text.render("<div>" * 20_000 + "x") == "x" and html_text.render("<table><td>" * 500 + "x") == "x"
    pages = spark.createDataFrame([(1, None, "a"), (2, "<p>x", "b")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(pages).orderBy("page_id").collect()] == [(1, None, None), (2, "<p>x", "x")]
    assert html_text.extract(pages.limit(0)).collect() == [] and html_text.extract(pages.union(pages)).count() == 4


def unigram_mode(path):
    """The library's own best-score segmentation over the same pieces: the model with its type changed."""
    raw = open(path, "rb").read()
    at = raw.rindex(b"\x18\x02", 0, len(raw) - 100)
    fields = [v for n, v in sentence_pieces.wire(raw) if n == 2]
    at = raw.rindex(fields[0]) + fields[0].rindex(b"\x18\x02 \x80\xfa\x01")
    return sentencepiece.SentencePieceProcessor(model_proto=raw[: at + 1] + b"\x01" + raw[at + 2 :])


@cache
def normal_pieces(codec):
    v = codec.vocabulary
    return {p: (i, s) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)) if k == sentence_pieces.NORMAL}


def brute(codec, text):
    table = normal_pieces(codec)
    best = [(0.0, 0, [])]
    for end in range(1, len(text) + 1):
        found = [(best[a][0] + table[text[a:end]][1], a, [table[text[a:end]][0]]) for a in range(max(0, end - 16), end) if text[a:end] in table]
        if text[end - 1] not in table:
            found.append((best[-1][0] + codec.lowest, end - 1, [codec.bytes[b] for b in text[end - 1].encode()]))
        best.append(max(found, key=lambda x: x[0]))
    at, ids = len(text), []
    while at:
        ids[:0] = best[at][2]
        at = best[at][1]
    return ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcthe in\n\tÉ日x😀́", max_size=20))
def test_pieces_are_best(text):
    codec = sentence_pieces.codec(PIECES)
    ids, at = codec.encode(*textops.flat(pa.array([text, None, "", text])))
    assert at.tolist() == [0, len(ids) // 2, len(ids) // 2, len(ids) // 2, len(ids)]
    own = ids[: at[1]].tolist()
    assert own == (brute(codec, "▁" + text.replace(" ", "▁")) if text else []) and codec.decode(own) == text


def test_unknown_inside_a_longer_piece():
    kinds = [sentence_pieces.UNKNOWN] + [sentence_pieces.NORMAL] * 3
    codec = sentence_pieces.Codec(sentence_pieces.Vocabulary(["<unk>", "AB", "BC", "D"], [0.0, -1.0, -50.0, -2.0], kinds, False))
    assert codec.segment("ABC") == [1, 0] and codec.segment("BCD") == [2, 3] and codec.segment("xD") == [0, 3] and codec.segment("") == []


def test_pieces_score_as_in_library(spark):
    """The library's n-best lattice finds no better segmentation of a word."""
    library, codec = unigram_mode(PIECES), sentence_pieces.codec(PIECES)
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(20).collect() for w in r.text.split()})[:1500]
    ids, at = codec.encode(*textops.flat(pa.array(words)))
    score = lambda own: sum(codec.vocabulary.scores[i] for i in own)
    for w, a, b in zip(words, at[:-1], at[1:], strict=True):
        assert score(ids[a:b].tolist()) == score(library.nbest_encode(w, nbest_size=2)[0])


def test_op8(spark):
    got = queries.op8_sentence_pieces(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    codec = sentence_pieces.codec(PIECES)
    words: dict[str, list[int]] = {}
    for r in got:  # a best segmentation cuts before each space that follows something else
        parts = re.findall(r" *[^ ]+| +$", " " + texts[r.doc_id]) if texts[r.doc_id] else []
        ids = [i for w in parts for i in words.setdefault(w, brute(codec, w.replace(" ", "▁")))]
        assert (r.n_pieces, r.ids_crc32, r.decoded_sha256) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a  b\n"), (4, "x" * 5000)], "doc_id long, text string")
    encoded = sentence_pieces.encode(docs, PIECES)
    assert [r.decoded for r in sentence_pieces.decode(encoded, PIECES).orderBy("doc_id").collect()] == [None, "", "a  b\n", "x" * 5000]
    assert [r.piece_ids for r in encoded.orderBy("doc_id").collect()][:2] == [None, []] and sentence_pieces.encode(docs.limit(0), PIECES).count() == 0


@cache
def bpe():
    return Tokenizer.from_file(BPE), packing.tokenizer_encoder(BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "É", "9", "½", "!", "日", " ", "́", "😀", "don't", "'s'm", "<|endoftext|>", "\x1c", " "]), max_size=12).map("".join), max_size=4))
def test_ids_are_the_tokenizers(texts):
    library, encoder = bpe()
    got = packing.document_ids(encoder, *textops.flat(pa.array(texts, pa.string())))
    assert [g.tolist() for g in got][: len(texts)] == [x.ids + [1] for x in library.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens():
    texts = ["hello <|endoftext|> world", "<|endoftext", "|>", "a<|endoftext|>", None]
    flat = textops.flat(pa.array(texts))
    assert [g.tolist() for g in packing.document_ids(bpe()[1], *flat)][0] == [31373, 220, 50256, 995, 1]
    plain = [g.tolist() for g in packing.document_ids(packing.tokenizer_encoder(BPE, special_as_text=True), *flat)]
    assert 50256 not in plain[0] and plain[1:3] == [g.tolist() for g in packing.document_ids(bpe()[1], *flat)][1:3]


def check_packed(rows, ids):
    """rows: (doc, start, length, crc, total, sequence, offset)"""
    pieces, sequences = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        assert total == len(ids[doc]) and length > 0 and zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes()) == crc
        pieces.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    for found, whole in ((pieces, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for key, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == whole[key] if whole else at <= packing.CAPACITY
    assert set(pieces) == set(ids)
    return sum(packing.CAPACITY - sum(n for _, n in s) for s in sequences.values())


def test_op9(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    library = Tokenizer.from_file(BPE)
    ids = {d: x.ids + [1] for d, x in zip(docs.doc_id, library.encode_batch(docs.text.tolist(), add_special_tokens=False), strict=True)}
    rows = [tuple(r) for r in queries.op9_packing(spark, "/root/testdata/sf0.01").collect()]
    assert check_packed(rows, ids) < 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packer(lengths):
    packer, ids = packing.Packer(pool=4), {i: np.arange(n, dtype=np.uint32) for i, n in enumerate(lengths)}
    placed = [x for i, own in ids.items() for x in packer.add(i, own)] + [*packer.end()]
    rows = [(d, a, len(x), zlib.crc32(x.astype("<u4").tobytes()), t, k, o) for (d, a, x, t), k, o in placed]
    padding = check_packed(rows, ids)
    assert padding < 2048 and len({r[5] for r in rows}) == -(-sum(lengths) // 2048)


def test_cost_is_balanced():
    packer = packing.Packer(capacity=100, pool=100)
    for n in [90, 80, 20, 10] * 10:
        list(packer.add(0, np.zeros(n, np.uint32)))
    costs = {}
    for (_, _, ids, _), k, _ in packer.end():
        costs.setdefault(k, []).append(len(ids))
    assert sorted(map(tuple, map(sorted, costs.values()))) == [(10, 90)] * 10 + [(20, 80)] * 10


def test_packing_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 2), (2, "", 1), (4, "x y " * 9000, 0)], "doc_id long, text string, offset int").coalesce(1)
    rows = packing.pack(docs, BPE, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 3 and all(r.ids == [1] for r in rows if r.doc_id in (1, 2))
    assert sum(r.length for r in rows if r.doc_id == 4) == [r.doc_tokens for r in rows if r.doc_id == 4][0]
    assert packing.pack(docs.limit(0), BPE).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<svg><defs/><text>visible</text></svg>", "visible"), ("<svg><metadata/><title/><text>v</text></svg>", "v"), ("<svg><desc/><style/><g><text>v</text></g></svg>x", "vx"), ("<math><mi>a</mi><annotation/><mo>b</mo></math>", "ab"),
    ("<svg/>y", "y"), ("<svg><foreignObject><div/>in</div></foreignObject></svg>z", "in\nz"), ("<p/>a<p/>b", "a\n\nb"), ("<defs/>gone", ""),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a  b\n   c  d"), ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td colspan=2>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td>a<br>b<td>c<tr><td><td>d</table>", "a  c\nb\n   d"), ("<table><tr><td>" + "w" * 130 + "<td>r<tr><td>s<td>t</table>", "w" * 130 + "  r\ns" + " " * 129 + "t"),
])
def test_html_leaves_and_spans(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("page", [
    lambda n: "<table><tr><td>" + "x" * 10 * n + "<td>y" + "<tr><td>a<td>b" * n + "</table>",
    lambda n: "<table>" + "<tr><td colspan=1000 rowspan=65534>a" * n + "</table>",
    lambda n: "<table><tr>" + "<td>a" * n + "<tr><td>b" * n + "</table>",
    lambda n: "<table><tr>" + "<td>a" * n + "<td>" + "b<br>" * n + "</table>",
    lambda n: "<table>" + "<tr><td rowspan=65534>a<td>b" * n + "</table>",
])
def test_html_tables_take_time_and_text_in_proportion(page):
    html_text.render(page(100))
    took = []
    for n in (1000, 4000):
        began = time.process_time()
        out = html_text.render(page(n))
        took.append(time.process_time() - began)
        assert len(out) < 100 * len(page(n))
    assert took[1] < 10 * took[0] + 0.5
