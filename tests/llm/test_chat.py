import itertools

import duckdb
import numpy as np
from compare import same

from quillgrove.llm import chat, common


def test_round_trip(spark):
    """All turns of the table, half of whose conversations and six of whose fourteen styles no model was fitted on."""
    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    same(chat.op10_chat(spark, d), duck, chat.ORACLE)


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(0)
    m = chat.Model(rng.standard_normal(6), rng.standard_normal((6, 6)), [rng.standard_normal((3, 6))], [{"a": 0, "b": 1}])
    seen = [("a",), ("b",), ("c",), ("a",)]
    at = [0, 1, 2, 0]
    score = lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(m.emit[0][o, s] for o, s in zip(at, p))
    assert tuple(chat.viterbi(m, seen)) == max(itertools.product(range(6), repeat=4), key=score)


def test_held_out_styles(spark):
    convs = common.read(spark, "/root/testdata/sf0.01", "conversations")
    m = chat.fit(convs.where("conv_id % 2 = 0"))
    rows = convs.where("conv_id % 2 = 1").orderBy("conv_id", "turn").collect()
    right = n = 0
    for conv, g in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        g = list(g)
        for s in chat.UNSEEN:
            text = "\n".join(s[chat.ROLES.index(r["role"])] + r["text"] for r in g)
            right += [(r["role"], r["text"]) for r in g] == chat.parse(m, text)
            n += 1
    assert right / n > 0.98


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hello\nthere", 5), (1, 1, None, None, 5), (1, 1, "assistant", "", 5), (None, 0, "user", "x", 5), (2, None, "weird", "y " * 50_000, None), (2, None, "weird", "y " * 50_000, None)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, transcript long")
    m = chat.fit(common.read(spark, "/root/testdata/sf0.001", "conversations"))
    out = chat.parsed(chat.transcripts(convs), m).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"][:11]) for r in out] == [(1, 0, "user", "hello\nthere"), (1, 1, "assistant", ""), (1, 2, "user", ""), (2, 0, "user", "y y y y y y"), (2, 1, "user", "y y y y y y")]
    assert chat.parsed(chat.transcripts(convs.where("false")), m).count() == 0
    assert chat.parse(chat.fit(convs.where("false")), "User: a\nAI: b")
    t = spark.createDataFrame([(1, None), (2, ""), (3, "User: x"), (3, "User: x")], "conv_id long, transcript string")
    assert [(r["conv_id"], r["text"]) for r in chat.parsed(t, m).orderBy("conv_id").collect()] == [(2, ""), (3, "x"), (3, "x")]
