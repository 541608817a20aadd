"""Bodies are parsed by one Python step per row, not by expressions over lines that Spark interprets."""

import pyarrow as pa
import pytest

from clausewood import queries
from clausewood.operators.body import parse_body, sections_array

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p6_blocks_by_kind", "i6_definitions", "r44_duration_invalid_unit"])
def test_one_python_step_reads_a_contract(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "regexp_extract_all(array_join(transform(" not in plan


def test_odd_bodies():
    assert parse_body("") == [] and parse_body("no heading\n\n- a") == []
    (only,) = parse_body("# A {#a}\x0b1. x\n   y\n- z\n\n| h |\n\n# Signature Block {#signature-block}\n# Gone")
    assert only == ("A", 1, "a", [{"kind": "ordered_list", "items": ["x y"]}, {"kind": "unordered_list", "items": ["z"]}])
    assert [b["kind"] for b in parse_body("#　É \n---\n> a\n>\tb\n١. x\n-\n")[0][3]] == ["rule", "quote", "ordered_list", "paragraph"]
    found = sections_array(pa.array(["# T\n\n|a||b|\n|-|\n|c|", "x", "# U"])).to_pylist()
    assert [len(d) for d in found] == [1, 0, 1] and found[0][0]["blocks"][0]["rows"] == [["c"]] and found[2][0]["blocks"] == []
