from textloom import session
from textloom.sources import files


def test_clear_removes_what_was_made(spark):
    df = session.materialize(spark.range(5), "few")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 5 and session.exists(spark, path)
    assert session.clear(spark) >= 1 and not session.exists(spark, path) and session.clear(spark) == 0


def test_ordered_sentences(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(f"{name}1 O\n{name}2 B-X\n\n{name}3 O\n\n\n{name}4 O\n")
    got = {(r.file, r.sent, r.pos, r.token) for r in files.read_tagged(spark, str(tmp_path), ordered=True).collect()}
    assert got == {(n, s, p, f"{n}{t}") for n in "ab" for s, p, t in ((0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 4))}
    assert len({r.sent for r in files.read_tagged(spark, str(tmp_path)).collect()}) == 6
