from uwlens.llm import preference


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, side string, turn int, role string, text string, prompt string")


def test_prefix_is_rendered_once_and_masks_cover_answers(spark):
    rows = [(1, s, 0, "user", "Hi", "x") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 1, "assistant", "Goéd", None), (1, "chosen", 2, "user", "ok", None), (1, "rejected", 1, "assistant", "Bad", None)]
    r = preference.format_preferences(pairs(spark, rows)).first()
    assert r.prompt == "<|user|>\nHi<|end|>\n" and r.prompt_turns == 1
    assert r.chosen == "<|assistant|>\nGoéd<|end|>\n<|user|>\nok<|end|>\n"
    assert [r.chosen[s.start:s.end] for s in r.chosen_spans] == ["Goéd<|end|>"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_spans] == ["Bad<|end|>"]


def test_awkward_pairs(spark):
    rows = [(1, "chosen", 0, None, None, None), (1, "rejected", 0, "", "", None),  # null equals empty: all prompt
            (2, "chosen", None, "assistant", "a", None),  # one side only
            (3, "chosen", 0, "user", "a", None), (3, "chosen", 0, "user", "a", None), (3, "rejected", 0, "user", "a", None),  # repeated turn
            (None, "chosen", 0, "user", "a", None), (4, "other", 0, "user", "a", None)]
    got = {r.pair_id: r for r in preference.format_preferences(pairs(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert (got[2].prompt, got[2].rejected) == ("", "") and got[2].chosen == "<|assistant|>\na<|end|>\n"
    assert got[3].prompt_turns == 1 and got[3].chosen == "<|user|>\na<|end|>\n" and got[3].rejected == ""
    assert preference.format_preferences(pairs(spark, rows).where("pair_id > 9")).count() == 0


def test_round_trip_of_given_conversations(spark):
    """Prompt plus chosen completion is the whole conversation, rendered."""
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = {}
    for r in sorted(conversations.collect(), key=lambda r: (r.conv_id, r.turn)):
        rows[r.conv_id] = rows.get(r.conv_id, "") + f"<|{r.role}|>\n{r.text}<|end|>\n"
    got = preference.format_preferences(preference.swapped_answer_pairs(conversations)).collect()
    assert {r.pair_id: r.prompt + r.chosen for r in got} == rows
    assert all(r.chosen != r.rejected or not r.chosen for r in got)
