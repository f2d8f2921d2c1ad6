"""P18/P19 traps: the label prefix is removed only when ' — ' falls within
the first len(label) + 4 characters; an empty remainder keeps the text;
the label may come from the locator; locator gaps are filled."""

from runlens.operators.atoms import flatten_atoms

SCHEMA = ("id long, deal_id string, atom_type string, artifact_id string, confidence double, "
          "calibrated_confidence double, raw_text string, normalized_text string, "
          "value map<string,string>, entity_keys array<string>, "
          "source_refs array<struct<filename:string,artifact_id:string,extraction_method:string,"
          "locator:map<string,string>>>, receipts array<struct<kind:string,status:string>>, "
          "authority_class string, review_status string, parser_version string")


def _row(i, value, raw, locator=None):
    refs = [("f.txt", None, "chat", locator or {})] if locator is not None else None
    return (i, "d", "t", "a", 0.5, None, raw, None, value, [], refs,
            [("", "OK"), ("k", "no")], None, None, None)


def test_body_and_speaker_rules(spark):
    rows = [
        _row(1, {"said_by": "Ann", "text": "Ann — hello"}, "x"),
        _row(2, {"said_by": "Ann", "text": "Ann said more — x"}, "x"),
        _row(3, {"said_by": "Ann"}, "Ann — "),
        _row(4, {"text": "Bo — hi", "party": "p1"}, "x", {"speaker": "Bo", "section_path": "s"}),
        _row(5, {"text": "  plain  "}, "x", {"section_path": "s"}),
    ]
    got = {r.id: r for r in flatten_atoms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].raw_text == "hello" and got[1].value_said_by == "Ann"
    assert got[2].raw_text == "Ann said more — x"
    assert got[3].raw_text == "Ann — "
    assert got[4].raw_text == "hi" and got[4].section_path == "Bo"
    assert got[4].value_speaker == "Bo" and got[4].locator_party == "p1"
    assert got[4].locator_section_path == "Bo"
    assert got[5].raw_text == "plain" and got[5].section_path == "s"
    assert got[1].verified and got[1].receipt_kinds == "k"
