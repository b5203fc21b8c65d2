import pytest

from sleuthwork.operators import subjects


@pytest.mark.parametrize("text,want", [
    ("@a/x crashes on start.", {("subject_package", "@a/x")}),
    ("@a/x does not crash.", {("healthy", "@a/x")}),
    ("@a/x did not load.", {("subject_package", "@a/x")}),
    ("@a/x is not working", {("subject_package", "@a/x")}),
    ("@a/x is healthy.", {("healthy", "@a/x")}),
    ("@a/x is healthy. Later @a/x crashes.", {("conflicted", "@a/x")}),
    ("We import @a/x here.", {("subject_dependency", "@a/x")}),
    ("import @a/x, but it crashes", {("subject_package", "@a/x")}),
    ("error in @a/x/sub", {("subject_package", "@a/x")}),
    ("@a/x was mentioned", {("unresolved", "@a/x")}),
    ("it uses theme@1.2.3 which is fine", {("healthy", "theme")}),
    ("@a/x stopped responding", {("subject_package", "@a/x")}),
    ("We import @a/x. It is healthy.", {("healthy", "@a/x")}),
    ("We import @a/x. It malfunctions.", {("subject_dependency", "@a/x"), ("pointed", "true")}),
    ("Said package is operational.", {("pointed_unnamed", "true")}),
    ("The server crashes often.", {("unbound", "true")}),
    ("the client-modules are `theme-engine`", {("subject_module", "client-modules"), ("subject_module", "theme-engine")}),
    ("a time-sensitive customer-facing thing", set()),
])
def test_features(text, want):
    got = {(k, v) for k, v in subjects.features(text)}
    assert got == want or got - {("unresolved", "@a/x")} == want


def test_quotation():
    text = "Copied from a resolved ticket:\n    @a/x crashes\n> @b/y fails\n```\n@c/z dies\n```\nOurs is @d/w.\n    at indented.trace"
    spans = subjects.quoted_spans(text)
    inside = [text[s:e] for s, e in spans]
    assert len(inside) == 3 and "@a/x" in inside[0] and "@b/y" in inside[1] and "@c/z" in inside[2]
    out = subjects.blank(text, spans)
    assert len(out) == len(text) and "@c/z" not in out and "@d/w" in out and "indented" in out


def test_classify_and_two_passes(spark):
    rows = [(1, "@org/client-modules crashes"), (2, "the client-modules thing"), (3, None), (4, "> @q/q fails\nfine"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in subjects.two_pass(df).collect()}
    assert (1, "stated", "subject_package", "@org/client-modules") in got and (2, "stated", "subject_module", "client-modules") in got
    assert (4, "quoted", "subject_package", "@q/q") in got and not any(r[0] in (3, 5) for r in got)
