"""Conversations from rows go by the fingerprint of their record, as JSON records do."""

from foliolith.llm import chat

ROWS = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", None), (1, 2, "user", "a </s> b"), (2, 0, None, "x"), (None, 0, "human", "y")]


def test_rows_have_the_fingerprint_and_mapping_of_their_record(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    same = chat.format_records(chat.records_from_rows(rows)).select("conv_id", "fingerprint", "turns", "formatted").collect()
    assert sorted(map(str, chat.format_rows(rows).collect())) == sorted(map(str, same))
    paths = "messages[].content,messages[].role"
    swapped = chat.format_rows(rows, {paths: {"turns": ("messages", "content", "role")}}).filter("conv_id = 1").first()
    assert [(t["role"], t["text"]) for t in swapped["turns"]] == [("a </s> b", "user"), ("", "assistant"), ("a </s> b", "user")]
    other = chat.format_rows(rows, {k: v for k, v in chat.MAPPINGS.items() if k != paths}).collect()
    assert len(other) == 3 and all(r["turns"] is None and r["formatted"] is None for r in other)
