import pytest

from trajspark.operators import mixture
from trajspark.plans.kql import Condition, KqlParseError, parse


def test_forms():
    assert parse("task CONTAINS 'a b' and NUM_FRAMES >= -5 AND success = none") == [Condition("task", "CONTAINS", "a b"), Condition("num_frames", ">=", -5), Condition("success", "=", None)]
    assert parse("fps = 0.5") == [Condition("fps", "=", 0.5)]
    assert parse("fps = (.5)") == [Condition("fps", "=", 5)]


@pytest.mark.parametrize("text,kind", [("", "EmptyQuery"), ("nope = 1", "UnknownField"), ("fps", "UnexpectedEnd"), ("fps 1", "ExpectedOperator"), ("fps = 1.2.3", "InvalidNumber"), ("fps = 1 x", "ExpectedAnd"), ("'fps' = 1", "ExpectedField"), ("task = 'a", "UnterminatedString")])
def test_errors(text, kind):
    with pytest.raises(KqlParseError) as e:
        parse(text)
    assert e.value.kind == kind


def test_generator_and_jump():
    x, seen = 42, []
    for _ in range(200):
        x = mixture.xorshift(x)
        seen.append(x)
    assert seen[:2] == [45454805674, 11532217803599905471]
    assert [mixture.jump(42, k + 1) for k in (0, 1, 50, 199)] == [seen[k] for k in (0, 1, 50, 199)]
    with pytest.raises(ValueError):
        mixture.Mixture([])
    with pytest.raises(ValueError):
        mixture.Mixture([("a", 3, 0.0)])
