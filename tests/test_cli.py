"""The command line lists and rejects queries without starting Spark."""

from lodgelake.__main__ import main


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert "hotel_performance" in out and "booking_json" in out and not any("no oracle SQL" in x for x in out)


def test_unknown_query(capsys):
    assert main(["show", "no_such_query"]) == 2
    assert "unknown query" in capsys.readouterr().err
