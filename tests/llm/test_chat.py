import hashlib
import random

from lodestone.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SEP]", "[END]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/", "s>", "END]", "a", "é", "\U0001f600", "\n", "$1", " "]


def conversations(n=300, seed=8):
    """Turns made of what control strings are made of."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
    return [[(rng.choice(["user", "assistant", "system", "[END]", "a[/ROLE]"]), text()) for _ in range(rng.randrange(1, 7))] for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    rows = conversations()
    given_rows = [(c, n, role, text) for c, turns in enumerate(rows) for n, (role, text) in enumerate(turns)]
    found = chat.read_back(chat.formatted(spark.createDataFrame(given_rows, TURNS))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(t.role, t.text) for t in r.turns] == rows[r.conv_id]
        assert r.loss_text == "".join(t for role, t in rows[r.conv_id] if role == "assistant")
        # No control string but the template's own: as many block ends as blocks.
        roles = [role for role, _ in rows[r.conv_id]]
        blocks = 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert r.formatted.count("[END]") == blocks and r.formatted.count("</s>") == 1 and r.formatted.count("[INST]") == 0
        assert r.formatted.count("[SEP]") == len(roles) - blocks


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: r for r in chat.op2_query(spark, sf).collect()}
    assert set(found) == set(turns)
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (found[k].n_turns, found[k].turns_sha256) == (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)))
        assert (found[k].loss_chars, found[k].loss_sha256) == (len(loss), sha(loss))


def test_odd_rows(spark, folder):
    rows = [(1, 2, "assistant", None), (1, 1, None, "x"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, "user", ""), (None, 1, "assistant", "y"), (None, None, None, None), (3, 1, "assistant", "z" * 200_000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("turns"), F.lit("x").alias("formatted"), F.lit("y").alias("loss"))
    found = {r.conv_id: r for r in chat.op2_query(spark, folder(conversations=df)).collect()}
    assert set(found) == {1, 2, 3, None, -1}
    assert found[1].n_turns == 4 and found[1].turns_sha256 == sha("\nx\nuser\na\nuser\na\nassistant\n\n")
    assert found[3].loss_chars == 200_000 and found[None].n_turns == 2 and found[2].turns_sha256 == sha("user\n\n")


def test_empty_table(spark, folder):
    found = chat.op2_query(spark, folder(conversations=spark.createDataFrame([], TURNS))).collect()
    assert [r.conv_id for r in found] == [-1]


def test_clashing_columns(spark, folder):
    """Columns that the operator's own steps are named after, beside the four it reads."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    crowded = plain.selectExpr("*", *[f"'{n}' AS `{n}`" for n in ("turns", "pieces", "loss", "formatted", "loss_text", "t", "at")])
    found = chat.op2_query(spark, folder(conversations=crowded)).collect()
    want = chat.read_back(chat.formatted(plain)).select("conv_id", "formatted").collect()
    assert {(r.conv_id, r.formatted_chars) for r in found if r.conv_id != -1} == {(r.conv_id, len(r.formatted)) for r in want}
