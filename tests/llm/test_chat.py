from weft.llm.chat import END, rotate

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hé 👍🏽"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "cy", "me too"), (2, 0, "system", "alone"), (3, None, "user", "late"), (3, 5, "user", "early"), (3, 5, "user", "early"), (3, 6, None, "who"), (None, 1, "user", "lost"),
]


def brute(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0))
        for speaker in {t[2] or "unknown" for t in rows} - {"system"}:
            at = 0
            for piece, (_, turn, role, text) in enumerate(rows):
                role, text = role or "unknown", text or ""
                header = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                whole = header + text + END
                mask = (at + len(header), at + len(whole) - 1) if role == speaker else (None, None)
                out.append((conv, speaker, piece, turn, whole, at, at + len(whole), *mask))
                at += len(whole)
    return sorted(out, key=str)


def test_against_plain_python(spark):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, speaker string, piece int").coalesce(1)
    got = rotate(turns)
    assert sorted(((r["conv_id"], r["speaker"], r["piece"], r["turn"], r["rendered"], r["start"], r["end"], r["mask_start"], r["mask_end"]) for r in got.collect()), key=str) == brute(TURNS)


def test_masks_are_the_contents(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in conv.collect()}
    whole = {}
    rows = sorted(rotate(conv).collect(), key=lambda r: r["piece"])
    for r in rows:
        key = (r["conv_id"], r["speaker"])
        whole[key] = whole.get(key, "") + r["rendered"]
        assert len(whole[key]) == r["end"]
    for r in rows:
        if r["trained"]:
            assert whole[r["conv_id"], r["speaker"]][r["mask_start"] : r["mask_end"]] == texts[r["conv_id"], r["turn"]] + END[:-1]


def test_long_and_empty(spark):
    turns = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "repeat('x', cast(id % 7 AS int)) AS text")
    got = rotate(turns)
    assert got.count() == 6000
    last = got.where("piece = 2999 AND speaker = 'a'").first()
    assert last["end"] == sum(len("<|assistant|>\n" if i % 2 == 0 else "<|user name=b|>\n") + i % 7 + len(END) for i in range(3000))
    assert rotate(turns.limit(0)).count() == 0
