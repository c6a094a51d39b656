import pytest

from grafwerk.functions import stcode

CODE = """// demo
IF a AND NOT b THEN
  x := TRUE;
  IF c THEN
    x := y;
  END_IF;
ELSIF d THEN
  x := FALSE;
ELSE
  x := t1.Q;
END_IF;
t1(IN := a AND (b OR c), PT := T#5s);"""


def test_assignments_carry_their_guards():
    assert stcode.assignments(CODE, "x") == [
        (3, "x", "TRUE", ["IF@2: a AND NOT b"]),
        (5, "x", "y", ["IF@2: a AND NOT b", "IF@4: c"]),
        (8, "x", "FALSE", ["ELSIF@2: d"]),
        (10, "x", "t1.Q", ["ELSE@2 (zu IF: a AND NOT b)"]),
    ]
    assert stcode.later(stcode.assignments(CODE, "x")) == [[5, 8, 10], [8, 10], [10], []]
    assert stcode.guard_condition("ELSE@2 (zu IF: a AND NOT b)") == "NOT (a AND NOT b)"


def test_calls_and_declarations():
    assert stcode.calls(CODE) == [(12, "t1", 1, {"IN": "a AND (b OR c)", "PT": "T#5s"})]
    assert stcode.declarations("VAR_INPUT\n a, b : BOOL := TRUE; (* x *)\nEND_VAR\nVAR\n m AT %Q0.1 : INT;\n s : STRING(20) := 'x;y';\nEND_VAR") == [
        ("VAR_INPUT", "a", "", "BOOL", "TRUE"),
        ("VAR_INPUT", "b", "", "BOOL", "TRUE"),
        ("VAR", "m", "%Q0.1", "INT", ""),
        ("VAR", "s", "", "STRING(20)", "'x;y'"),
    ]


T, N = True, False
PATHS = [
    ("a AND (b OR NOT c)", [[("a", T), ("b", T)], [("a", T), ("c", N)]]),
    ("NOT (a OR b)", [[("a", N), ("b", N)]]),
    ("NOT (a AND (b OR c))", [[("a", N)], [("b", N), ("c", N)]]),
    ("(a OR b) AND NOT a", [[("b", T), ("a", N)]]),
    ("a OR a", [[("a", T)], [("a", T)]]),
    ("FALSE", []),
]


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize(("text", "paths"), PATHS)
def test_truth_paths(text, paths, compat):
    assert stcode.truth_paths(text, compat) == paths


ODD = [
    ("a AND NOT a", [], [[("a", T), ("a", T)]]),
    ("NotStopp AND b", [[("NotStopp", T), ("b", T)]], [[("Stopp", N), ("b", T)]]),
    ("x > 5 AND b", [[("x > 5", T), ("b", T)]], [[("x", T), ("b", T)]]),
    ("a XOR b", [[("a", T), ("b", N)], [("a", N), ("b", T)]], [[("a", T)]]),
]


@pytest.mark.parametrize(("text", "right", "odd"), ODD)
def test_oddities_only_in_compat_mode(text, right, odd):
    assert stcode.truth_paths(text) == right
    assert stcode.truth_paths(text, compat=True) == odd


def test_too_many_paths_are_an_error():
    with pytest.raises(ValueError, match="paths"):
        stcode.truth_paths(" AND ".join(f"(a{i} OR b{i})" for i in range(14)))


def test_block_diagram():
    code = "V_1 = OR_1(D1, F1)\nV_2 = AND_1(V_1, Stoer)\nV_3 = OR_2(D3, Abort)\nV_9 = RS_1(V_2, V_3)\nD2 = V_9"
    assert stcode.set_and_reset(code, "D2") == {"from": "V_9", "block": "RS_1", "set": "AND_1(OR_1(D1, F1), Stoer)", "reset": "OR_2(D3, Abort)"}
    assert ("V_1", "OR_1", 1, "F1") in stcode.edges(code)
    assert stcode.tree(stcode.diagram("A = f(B)\nB = g(A)"), "A").shown() == "f(g(A))"
    assert stcode.state_branch([["D1"], ["F1"]]) == 1
    assert stcode.state_branch([["D1"], ["F1"]], "D1") == 0
    with pytest.raises(ValueError, match="best"):
        stcode.state_branch([["F1"], ["F2"]])


def test_names_are_one_in_any_case():
    assert stcode.truth_paths("a AND NOT A") == []
    assert stcode.truth_paths("a AND A AND b") == [[("a", True), ("b", True)]]
    assert stcode.truth_paths("NOT (x XOR X)") == [[("x", True)], [("x", False)]]


@pytest.mark.parametrize("seed", range(40))
def test_paths_equal_a_truth_table(seed):
    """Every assignment makes a random expression true if and only if it fits one of its paths."""
    import itertools
    import random

    r = random.Random(seed)
    names = ["p", "q", "r", "s"]

    def made(depth):
        k = r.randrange(5) if depth else 0
        if k == 0:
            n = r.choice([*names, "TRUE", "FALSE"])
            n = n.upper() if r.random() < 0.3 else n
            return n, lambda v, n=n: v.get(n.lower(), n == "TRUE")
        a, f = made(depth - 1)
        if k == 1:
            return f"NOT ({a})", lambda v: not f(v)
        b, g = made(depth - 1)
        word, of = (("AND", lambda x, y: x and y), ("OR", lambda x, y: x or y), ("XOR", lambda x, y: x != y))[k - 2]
        return f"({a}) {word} ({b})", lambda v: of(f(v), g(v))

    text, value = made(4)
    paths = stcode.truth_paths(text)
    for bits in itertools.product((False, True), repeat=4):
        v = dict(zip(names, bits))
        assert value(v) == any(all(v[t.lower()] == need for t, need in p) for p in paths), text


def test_pairs_of_iris_and_objects():
    from grafwerk.operators import decide

    text = '"\n\n http://a \r\n  {"x": "} \\" {", "y": {"z": 1}}http://b\n{"k": 2}\nhttp://none\nhttp://c\n{"open": {"'
    assert decide.iri_pairs(text) == [
        {"iri": "http://a", "payload": '{"x": "} \\" {", "y": {"z": 1}}'},
        {"iri": "http://b", "payload": '{"k": 2}'},
        {"iri": "http://c", "payload": '{"open": {'},
    ]
    assert decide.iri_pairs(None) is None and decide.iri_pairs("") == []
