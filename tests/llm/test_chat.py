from marlstone.llm import chat
from marlstone.llm.queries import op3_chat
from tests.llm import oracle

SCHEMA = "conv_id long, turn long, role string, text string, n long, part string"


def convs(df):
    return {r.conv_id for r in df.collect()}


def test_same_as_sql(spark, sf):
    assert oracle.same(op3_chat(spark, sf), sf, chat.ORACLE)


def test_prefixes_copies_nulls_and_ties(spark):
    turn = lambda c, i, t, r="user": (c, i, r, t, 0, "x")
    rows = [turn(1, 0, "a"), turn(1, 1, "b"), turn(2, 0, "a"), turn(2, 1, "b"), turn(2, 2, "c"), turn(3, 5, "a"), turn(3, 6, "b"), turn(3, 9, "c"), turn(4, 0, "a"), turn(4, 1, "x"), turn(None, 0, "n"), turn(5, None, None, None), turn(6, 0, ""), turn(7, 0, "a", "assistant"), turn(8, 0, "d"), turn(8, 0, "d")]
    got = chat.collapse(spark.createDataFrame(rows, SCHEMA))
    assert convs(got) == {2, 4, None, 5, 6, 7, 8}
    assert got.where("conv_id = 2").first().rendered == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert got.where("conv_id = 8").first().turns == 2
    assert got.where("conv_id = 5").first().rendered == "<|unknown|>\n<|end|>\n"
    assert chat.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, i, "user", f"t{i}", 0, "") for i in range(3000)] + [(2, i, "user", f"t{i}", 0, "") for i in range(2999)] + [(3, i, "user", f"t{i + (i == 2500)}", 0, "") for i in range(2999)]
    got = chat.collapse(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert {r.conv_id for r in got} == {1, 3} and sum(r.turns for r in got if r.conv_id == 1) == 3000
    assert "".join(r.rendered for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1).count("<|end|>") == 3000
