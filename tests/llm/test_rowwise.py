import hashlib
import math
import random
import zlib

from polyrank.llm import media, mixing, pieces

from .cases import clashing, empty_documents, odd_documents, store


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = pieces.encode_documents(clashing(odd_documents(spark)), pieces.model_path(), with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd_documents(spark).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(empty_documents(spark), pieces.model_path()).count() == 0


def test_pieces_on_random_texts_and_small_tables():
    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), random.Random(7)
    table = pieces.ChunkTable(pieces.model_path(), size=5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "é", "　", "日", "\U0001f600", "ing", "<s>", "\x00", ",", "1"]) for _ in range(rng.randrange(40)))
        (ids, n, decoded), = table.encode([text])
        want = sp.encode(text)
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded == sp.decode(want)


def test_pieces_of_long_texts_without_spaces():
    import resource

    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), random.Random(8)
    table = pieces.ChunkTable(pieces.model_path())
    texts = ["".join(rng.choices(letters, k=n)) for letters, n in (("ab日本語", 5_000), ("0123456789abcdefXYZ+/=", 50_000), ("語漢字\U0001f600é", 3_000), ("the ing", 20_000), ("\n\t", 900), (" ", 700), ("a ", 2_000))]
    texts += ["word " + t + " tail" for t in texts] + ["x" + " " * 600 + "y" * 600]
    for text, (ids, n, decoded) in zip(texts, table.encode(texts), strict=True):
        want = sp.encode(text)
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded == sp.decode(want)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(40):  # 40 MB of distinct long chunks
        list(table.encode(["".join(rng.choices("日本語漢字中文", k=3_000)) + f"語{i}" for i in range(100)]))
    (ids, n, decoded), = table.encode(["日本語漢字中文" * 500_000])  # 10.5 MB without a space
    assert decoded == "日本語漢字中文" * 500_000 and n == ids.count(",") + 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000


def test_media_round_trip(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in odd_documents(spark).collect()}
    rows = {r.doc_id: r for r in media.media_columns(clashing(odd_documents(spark))).collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        payload = docs[i] + b"\0" * ((-len(docs[i])) % 64 or (64 if not docs[i] else 0))
        assert r.n_bytes == len(docs[i]) and r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        wav = media.to_wav(payload)
        assert media.from_wav(wav) == payload and r.media_bytes == len(wav) and r.media_sha256 == hashlib.sha256(wav).hexdigest()
        assert r.feature and len(r.times) == len(r.codes)
    assert rows[1].feature == rows[7].feature != rows[5].feature
    assert media.media_columns(empty_documents(spark)).count() == 0


def test_media_peaks_equal_one_by_one():
    texts = [f"text number {i} ".encode() * (i + 1) for i in range(40)]
    together = media.media_rows(list(range(40)), texts)["feature"]
    assert together == [media.media_rows([0], [t])["feature"][0] for t in texts]


def plain_feature(payload):
    """Landmarks by a plain short-time Fourier transform of each frame and the definition, one by one."""
    import cmath

    samples = [b - 128 for b in payload] + [0] * media.HOP
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    powers = []
    for f in range(len(payload) // media.HOP):
        frame = [samples[f * media.HOP + i] * hann[i] for i in range(media.FRAME)]
        powers.append([round(abs(sum(x * cmath.exp(-2j * math.pi * k * i / media.FRAME) for i, x in enumerate(frame))) ** 2) for k in range(1, media.FRAME // 2 + 1)])
    peaks = []
    for start in range(0, len(powers), media.BLOCK):
        block = powers[start : start + media.BLOCK]
        loudest = max(max(p) for p in block)
        t = next(i for i, p in enumerate(block) if max(p) == loudest)
        peaks.append((start + t, block[t].index(loudest)))
    pairs = [(t, b << 14 | c << 8 | min(255, u - t)) for i, (t, b) in enumerate(peaks) for u, c in peaks[i + 1 : i + 1 + media.FAN]]
    pairs = pairs or [(t, b << 14 | b << 8) for t, b in peaks]
    return " ".join(f"{t}:{c:x}" for t, c in sorted(pairs))


def test_media_features_equal_a_plain_transform():
    rng = random.Random(11)
    texts = [b"x", b"the cat sat on the mat " * 60, bytes(rng.randrange(256) for _ in range(3000)), b"", "日本語".encode() * 200]
    assert media.media_rows(list(range(5)), texts)["feature"] == [plain_feature(media.pad(t)) for t in texts]


def test_mixing(spark, tmp_path):
    import duckdb

    for n, df in enumerate((clashing(odd_documents(spark)), odd_documents(spark).union(odd_documents(spark)), empty_documents(spark))):
        path = store(df, tmp_path / str(n))
        got = mixing.op4_mixing(spark, path).collect()
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
        want = con.execute(mixing.OP4_SQL).fetchall()
        key = lambda r: (r[0], r[1], r[2], r[4])
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert all(r.taken <= 3 * r.size for r in got)
        by = {}
        for r in got:
            by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
        # equal targets and sizes stand for one source or more, whose budgets are each rounded
        assert all(abs(sum(v) / t - round(sum(v) / t)) * t <= 3 if t else not sum(v) for (_, t), v in by.items())


def test_mixing_in_any_order_of_rows(spark):
    rows = [(5, "a " * 3, "s"), (5, "b " * 50, "s"), (5, "c " * 400, "s"), (None, "d " * 7, "s"), (None, "e " * 90, "s"), (1, "f " * 900, "t")]
    results = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for n in (1, 3):
            keyed = mixing.with_keys(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n))
            results.add(tuple(sorted(((r.doc_id, r._size, r.taken) for r in mixing.mix_plan(keyed).collect()), key=str)))
    assert len(results) == 1


def test_mixed_documents_hold_what_is_taken(spark):
    df = odd_documents(spark)
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(mixing.with_keys(df)).collect()}
    got = {}
    for r in mixing.mix_documents(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").encode().split())
    assert got == {k: v for k, v in plan.items() if v}


def test_a_budget_that_ends_deep_in_a_long_text(spark):
    long = " \n".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long, "en", "b", len(long))], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(mixing.with_keys(df)).collect()}
    got = {}
    for r in mixing.mix_documents(df).collect():
        assert long.startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == plan and any(v % 60_000 for v in plan.values())
