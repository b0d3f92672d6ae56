"""The fitting sample isn't lowered to save time."""

from poolwright.llm import quality


def test_sample():
    assert quality.SAMPLE >= 6000 and quality.classify.__defaults__[0] == quality.SAMPLE
