"""Hostile and many-track containers, loop values of conversations, likenesses against exact sets."""

import struct

import pytest

pytest.importorskip("weftline.llm.media")

from weftline.llm import chat, fingerprints, media  # noqa: E402


def stored_payload(raw):
    """The samples of a one-track file, read by its boxes alone: a parse of its own."""
    boxes = {}

    def read(at, end):
        while at < end:
            size, kind = struct.unpack_from(">I4s", raw, at)
            boxes[kind] = (at + 8, at + size)
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                read(at + 8, at + size)
            at += size

    read(0, len(raw))
    fixed, n = struct.unpack_from(">II", raw, boxes[b"stsz"][0] + 4)
    sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", raw, boxes[b"stsz"][0] + 12))
    (k,) = struct.unpack_from(">I", raw, boxes[b"stsc"][0] + 4)
    runs = [struct.unpack_from(">III", raw, boxes[b"stsc"][0] + 8 + 12 * i) for i in range(k)]
    (c,) = struct.unpack_from(">I", raw, boxes[b"co64"][0] + 4)
    out, s = b"", 0
    for i in range(c):
        (at,) = struct.unpack_from(">Q", raw, boxes[b"co64"][0] + 8 + 8 * i)
        for _ in range([r[1] for r in runs if r[0] <= i + 1][-1]):
            out += raw[at : at + sizes[s]]
            at, s = at + sizes[s], s + 1
    assert s == n
    return out


@pytest.mark.parametrize("n", [64, 1024, 1088, 8192, 8256, 200_000 // 64 * 64])
def test_stored_form_by_another_parser(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    raw = media.mux(payload)
    assert stored_payload(raw) == payload == media.samples(raw, media.probe(raw)[0])


def fragments():
    """A file of two tracks whose samples stand in fragments."""
    trak = lambda i: media.box(b"trak", media.full(b"tkhd", struct.pack(">IIII", 0, 0, i, 0)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)), media.box(b"minf", media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1" if i == 1 else b"mp4a"))))))
    head = media.box(b"moov", trak(1), trak(2), media.box(b"mvex", *(media.full(b"trex", struct.pack(">5I", i, 1, 40, 0, 0x10000)) for i in (1, 2))))

    def moof(base):
        first = media.full(b"trun", struct.pack(">IiI", 3, base, 0), struct.pack(">3I", 5, 6, 7), flags=0x205)
        second = media.full(b"trun", struct.pack(">Ii", 2, base + 18), flags=1)
        return media.box(
            b"moof",
            media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1)), first),
            media.box(b"traf", media.full(b"tfhd", struct.pack(">III", 2, 4, 0), flags=0x30), second),
        )

    part = moof(len(moof(0)) + 8)
    return head + part + media.box(b"mdat", b"aaaaabbbbbbcccccccddddeeee"), len(head) + len(part) + 8


def test_fragments_and_all_tracks(spark):
    raw, at = fragments()
    video, sound = media.probe(raw)
    assert (video.codec, video.duration, video.sizes.tolist(), video.keys.tolist()) == ("avc1", 120, [5, 6, 7], [0])
    assert media.samples(raw, video) == b"aaaaabbbbbbccccccc" and media.samples(raw, sound) == b"ddddeeee"
    assert (sound.codec, sound.keys.tolist(), sound.starts.tolist()) == ("mp4a", [0, 1], [at + 18, at + 22])
    rows = media.inspect(spark.createDataFrame([(1, 0, bytearray(raw))], "doc_id long, n_bytes long, media binary")).collect()
    assert [t.codec for t in rows[0].tracks] == ["avc1", "mp4a"] and rows[0].error is None and rows[0].tracks[0].key_ends == [at + 5]


def test_hostile_files_are_errors(spark):
    deep = b""
    for _ in range(3000):
        deep = media.box(b"udta", deep)
    good = media.mux(bytes(640))
    huge = bytearray(good)
    at = good.index(b"stsz")
    huge[at + 8 : at + 16] = struct.pack(">II", 1, 0xFFFFFFFF)
    far = bytearray(good)
    at = good.index(b"co64")
    far[at + 12 : at + 20] = struct.pack(">Q", 1 << 40)
    cut = good[:-700]
    rows = [(i, 0, None if m is None else bytearray(m)) for i, m in enumerate((deep, huge, far, cut, b"", b"junk of no boxes", None, good))]
    got = {r.doc_id: r for r in media.inspect(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(got[i].error for i in range(7)) and got[7].error is None and got[7].payload_bytes == 640


def test_loop_values_are_of_the_whole_conversation(spark):
    template = "{% for m in messages %}{% if loop.first %}F{% endif %}{{ loop.index }}{% if loop.last %}L{% endif %};{% endfor %}"
    rows = [(c, t, "user", "x") for c in (1, 2, 3) for t in range(c)] + [(4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, None, None)]
    got = {}
    for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).orderBy("conv_id", "turn_index").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.formatted
    assert got == {1: "F1L;", 2: "F1;2L;", 3: "F1;2;3L;", 4: "F1;2L;", None: "F1L;"}
    empty = chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")))
    assert empty.count() == 0


def test_likeness_is_near_the_exact_one_and_extensions_are_exact():
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(200 + 40 * k)) for k in range(1, 9)]
    rows = [(i, t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]
    grams = lambda t: {t[i : i + fingerprints.GRAM] for i in range(len(t) - fingerprints.GRAM + 1)}
    for (_, text, after), r in zip(rows, fingerprints.describe(rows).to_pylist()):
        changed = fingerprints.edit(text, after)
        for other, near in ((changed, r["near_edited"]), (after, r["near_next"])):
            a, b = grams(text), grams(other)
            assert abs(near - len(a & b) / len(a | b)) < 0.25
        front = next((i for i, (x, y) in enumerate(zip(text, changed)) if x != y), len(text))
        back = next((i for i, (x, y) in enumerate(zip(text[::-1], changed[::-1])) if x != y), len(text))
        assert r["common_prefix"] == front and r["common_suffix"] == min(back, len(text) - front)


def test_edits_follow_ids_beyond_doubles_and_repeats(spark):
    ids = [2**60, 2**60 + 1, 2**60 + 2, 5, 5, None]
    docs = spark.createDataFrame([(d, f"text {i} " * 3) for i, d in enumerate(ids)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in fingerprints.fingerprint_edits(docs, parts=4).collect())
    assert got == sorted((d is None, d or 0, 21) for d in ids)
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs, parts=4).collect()}
    import hashlib

    want = fingerprints.edit("text 2 " * 3, "text 1 " * 3)
    assert rows[2**60 + 2].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
