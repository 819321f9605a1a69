import pytest

from braidql.lang import ParseError, parse
from braidql.lang import ast as A

DOT = A.Identity()


def field(name):
    return A.Field(DOT, name)


@pytest.mark.parametrize(
    "text, tree",
    [
        (".", DOT),
        (".a.b", A.Field(field("a"), "b")),
        ('.["a b"]', field("a b")),
        (".[-1]", A.Index(DOT, A.Literal(-1))),
        (".[1:]", A.Slice(DOT, A.Literal(1), None)),
        (".[]", A.Iterate(DOT)),
        (".[].x", A.Field(A.Iterate(DOT), "x")),
        ("1 + 2 * 3", A.Binary("+", A.Literal(1), A.Binary("*", A.Literal(2), A.Literal(3)))),
        (".a and .b or .c", A.Binary("or", A.Binary("and", field("a"), field("b")), field("c"))),
        ("not .a == 1", A.Binary("==", A.Not(field("a")), A.Literal(1))),
        ("f(.a; .b)", A.Call("f", (field("a"), field("b")))),
        ("f(.a, .b)", A.Call("f", (field("a"), field("b")))),
        ("{a, b: .c}", A.Object((("a", field("a")), ("b", field("c"))))),
        ("[1, 'x']", A.Array((A.Literal(1), A.Literal("x")))),
        (".a | .b | .c", A.Pipe((field("a"), field("b"), field("c")))),
        (".a, .b | .c", A.Sequence((field("a"), A.Pipe((field("b"), field("c")))))),
        (".a += 1", A.Assign("+=", field("a"), A.Literal(1))),
        (".a.b |= .c", A.Assign("|=", A.Field(field("a"), "b"), field("c"))),
        ("if .a then 1 else 2 end", A.If(field("a"), A.Literal(1), A.Literal(2))),
        ("try .a catch -1", A.Try(field("a"), A.Literal(-1))),
        ("del(.a)", A.Delete(field("a"))),
        ("$x", A.Variable("x")),
        ("join(other.csv; .a == .b)", A.Call("join", (A.Path("other.csv"), A.Binary("==", field("a"), field("b"))))),
        ('"tab\\t\\u0041"', A.Literal("tab\tA")),
        ("'raw\\n'", A.Literal("raw\\n")),
        ("123456789012345678901234567890", A.Literal(123456789012345678901234567890)),
        ("def f(x): x + 1; f(.a)", A.Binary("+", field("a"), A.Literal(1))),
        ("(map(.v) | add / length)", A.Pipe((A.Call("map", (field("v"),)), A.Binary("/", A.Call("add"), A.Call("length"))))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", ".a +", "map(", "if .a then .b end", ".a == .b == .c", "{a: }", ".a )", "[1, 2", "@"])
def test_errors_have_a_place(text):
    with pytest.raises(ParseError, match="line 1, column"):
        parse(text)
