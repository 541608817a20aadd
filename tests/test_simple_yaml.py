"""The line reader of simple frontmatter against the YAML library."""

import random

import pytest
import yaml

from clausewood.operators.frontmatter import NotSimple, TextDates, read_simple

CONTRACT = """title: Order 5
effective_date: 2026-02-30
sides:
  - name: buyers
    parties:
      - {name: c1, type: legal_entity, legal_name: "Customer#000000001"}
  - name: sellers
    label: The Sellers
    parties:
      - {name: s0, type: corporation}
attachments:
  - {id: schedule, title: Schedule, file: schedule.pdf}"""
PIECES = ["title", "on", "a b", "yes", "Null", "x:", "- ", "  ", " ", "\n", ": ", "{", "}", ", ", '"', "#", "2026-01-01", "12", "'", "\\", "y", "~", "[", "]", "&a", "*a", "---", "é", "-", "|", "name: c1"]


def by_library(text):
    try:
        return yaml.load(text, Loader=TextDates)
    except (yaml.YAMLError, ValueError, TypeError):
        return "refused"


def by_lines(text):
    try:
        return read_simple(text)
    except NotSimple:
        return None


def test_a_contract_needs_no_library():
    assert read_simple(CONTRACT) == by_library(CONTRACT)


@pytest.mark.parametrize("text", [
    "a:\n- {b: c}", "a: on", "on: a", "a: {on: b}", "a: b\na: c", "a: b\n  c: d", "a:\n  b: c\n d: e", "a: b c\n d", "a: {b: c}\n  d: e", "a: 1", "a: [b]", "- {a: b}", "a: b #c", "", "a: b\n", "a:\n  - {b: c}\n  d: e",
    "title: [unclosed", "a: \"b\\n\"", "a: {b: c, b: d}",
])
def test_other_texts_are_left_to_the_library(text):
    assert by_lines(text) is None


@pytest.mark.parametrize("text", ["a:", "a:\nb: c", "a:\n  b:\n    - c: d\n      e: f\n    - {g: h}\ni: j", "a:\n  - b:\n    c: d", "a:\n  - b:\n      - c: d\n    e: f", "a:\n    b: c\nd: yesterday", "a:\n  - b: c\n  - d:\n      e: f\ng:"])
def test_nested_texts(text):
    assert by_lines(text) == by_library(text)


def test_what_the_lines_give_the_library_gives():
    dice, taken = random.Random(7), 0
    for _ in range(12_000):
        text = CONTRACT if dice.random() < 0.8 else "a:\n  - b: c\n    d:\n      e: f\n  - {g: h}\ni:\n  j:\n    k: l"
        for _ in range(dice.choice([1, 1, 2, 3])):
            lo = dice.randrange(len(text) + 1)
            text = text[:lo] + dice.choice(["", *PIECES]) + text[lo + dice.choice([0, 0, 1, 2, 5]) :]
        if (found := by_lines(text)) is not None:
            taken += 1
            assert found == by_library(text), text
    assert taken > 1_000
