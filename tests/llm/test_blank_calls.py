from quintil.llm import toolcalls


def test_blanks_before_a_call_and_its_result(spark):
    rows = [("c", 0, "assistant", ' \r\n\t{"tool_calls":[{"id":"a","name":"f","arguments":{}}]}'), ("c", 1, "tool", '\n{"tool_call_id":"a","content":"x"}')]
    schemas = spark.createDataFrame([], "name string, argument string, kind string, required boolean")
    got = toolcalls.format_chat(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), schemas).collect()
    assert [(r.kind, r.call_id) for r in got] == [("call", "a")] and '"result":"x"' in got[0].json
