"""The cascade: its order, what it leaves out, and verdicts that depend on neither."""

import numpy as np
import pyarrow as pa
import pytest

from bytegrain.llm import quality
from bytegrain.llm.quality import Rule, Slice
from bytegrain.llm.text import buffer

GOOD = " ".join(f"word{k} and more" for k in range(40))
TEXTS = [GOOD, "# * $ | " * 30 + GOOD, "short", None, "", "same three words " * 40, "\n".join([GOOD] * 9), GOOD + "\n" * 200, "1234567 " * 60 + " ".join(str(k) for k in range(9000, 9100)), "ab " * 3 + GOOD, "é ü ß " * 3 + GOOD]


def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (0, GOOD), (None, GOOD)], "doc_id bigint, text string").repartition(3)


def stats(rules, measures, uses):
    return [{"kind": "rule", "name": n, "part": "", "seconds": s, "n": k} for n, s, k in rules] + [{"kind": "measure", "name": "", "part": m, "seconds": s, "n": 0} for m, s in measures] + [{"kind": "uses", "name": n, "part": m, "seconds": 0.0, "n": 0} for n, m in uses]


def test_order_is_by_rejections_per_second():
    a, b, c, d = (Rule(n, None) for n in "abcd")
    # b rejects most, but its measure is dear; a is cheap; c rides on b's measure; d rejects nothing
    found = quality.ordered((d, c, b, a), stats([("a", 0.1, 50), ("b", 0.1, 100), ("c", 0.1, 20), ("d", 0.01, 0)], [("x", 0.5), ("y", 5.0)], [("a", "x"), ("b", "y"), ("c", "y")]))
    assert [r.name for r in found] == ["a", "c", "b", "d"] or [r.name for r in found] == ["a", "b", "c", "d"]
    found = quality.ordered((b, c), stats([("b", 0.1, 100), ("c", 0.1, 20)], [("y", 5.0)], [("b", "y"), ("c", "y")]))
    assert [r.name for r in found] == ["b", "c"]
    assert quality.ordered((c, a), []) == [c, a]


def test_later_rules_see_what_is_left():
    seen = []

    def spy(name, bad):
        def rejects(s):
            seen.append((name, s.n))
            return np.array([t.startswith(bad) for t in s.data.tobytes().decode().split("|")[: s.n]])

        return Rule(name, rejects)

    s = Slice(*buffer(pa.array(["a|", "b|", "c|", "a|"], pa.large_string())))
    assert quality.cascade(s, [spy("one", "a"), spy("two", "b"), spy("three", "z")]).tolist() == [0, 1, -1, 0]
    assert seen == [("one", 4), ("two", 2), ("three", 1)]


@pytest.mark.parametrize("sample_rows", [0, 1, 2000])
def test_verdicts_depend_on_no_order(spark, sample_rows):
    rows = [quality.quality_filter(docs(spark), rules, sample_rows, measures=m, reasons=True).collect() for rules in (quality.RULES, quality.RULES[::-1]) for m in (True, False)]
    verdicts = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in x) for x in rows]
    assert all(v == verdicts[0] for v in verdicts) and len(verdicts[0]) == len(TEXTS) + 2
    reasons = {r["doc_id"]: r["rejected_by"] for r in rows[0]}
    assert reasons == {r["doc_id"]: r["rejected_by"] for r in rows[1]}
    assert (reasons[0], reasons[1], reasons[2], reasons[3], reasons[4], reasons[5], reasons[None]) == (None, "symbols", "few_words", "few_words", "few_words", "repeated_words", None)
    assert reasons[7] == "empty_lines" and reasons[8] is not None


def test_a_rejected_document_is_not_measured_further():
    s = Slice(*buffer(pa.array(["few words"] * 3, pa.large_string())))
    assert (quality.cascade(s, [*quality.BASE, *quality.RULES]) == 0).all()
    assert "n_repeat_words" not in s.made and "letters" not in s.made and "n_symbols" not in s.made
