import pytest

from panelgauge import spec as S


def test_crossed_design_has_all_sources_in_canonical_order():
    d = S.design("item", ["rater", "occasion"])
    assert list(d.terms) == ["item", "occasion", "rater", "item:occasion", "item:rater", "rater:occasion", "item:rater:occasion"]
    assert d.resolve("gaussian").aliased == ("item:rater:occasion",)
    with pytest.raises(S.SpecError):
        d.resolve("binary")


def test_nested_design():
    d = S.design("person", ["item", "question"], crossed=["question"], nested={"item": "question"}, item_nested=["item"])
    assert set(d.terms) == {"person", "question", "item:question", "person:question", "person:item:question"}
    assert d.scope("item") == ("item", "question")


@pytest.mark.parametrize("text,want", [
    ("~ a + b", [("a",), ("b",)]),
    ("~ a * b", [("a",), ("b",), ("a", "b")]),
    ("~ a / b", [("a",), ("a", "b")]),
    ("~ (a + b) / c", [("a",), ("b",), ("a", "b", "c")]),
    ("~ a + a:b + 1", [("a",), ("a", "b")]),
    ("~ a:(b + c)", [("a", "b"), ("a", "c")]),
])
def test_formula_grammar(text, want):
    assert [set(t) for t in S.formula_terms(text)] == [set(t) for t in want]


@pytest.mark.parametrize("text", ["~ a - b", "~ log(a)", "~ a +", "~ a b", "~ (a", "~ 2"])
def test_formula_refuses(text):
    with pytest.raises(S.SpecError):
        S.formula_terms(text)


def test_model_formula():
    outcomes, d = S.model_formula("cbind(y, z) ~ rater * item", measured="item")
    assert outcomes == ["y", "z"] and d.object == "item" and d.facets == ("rater",)


@pytest.mark.parametrize("make", [
    lambda: S.design("item", ["item"]),
    lambda: S.design("a:b", ["c"]),
    lambda: S.design("o", ["a", "b"], crossed=["a"]),
    lambda: S.design("o", ["a", "b", "c"], crossed=["a"], nested={"b": "c", "c": "b"}),
    lambda: S.design("o", ["a"], random=["a"]),
    lambda: S.design("o", list("abcdefghijklm")),
    lambda: S.Family("binary", levels=("a",)),
    lambda: S.Family("ordinal", "softmax"),
    lambda: S.Score({"y": 0.0}),
    lambda: S.Batch(1),
])
def test_refusals(make):
    with pytest.raises(S.SpecError):
        make()
