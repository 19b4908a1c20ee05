"""Line structure in segments against the block reader of the chunker."""

import random

import pytest

from stratiform.operators import chunk, outline

LINES = ["", " ", "# One", "## Two", "###### Six", "#", "text", "more text", "- item", "1. item", "  * item", "===", "---", "--", "```", "````", "~~~~", "~~~", "```py", "   ```", "    ```", "====", "é # x", "####### seven"]


def expected(text):
    """Per line: (begins, inside, heading path) from the blocks."""
    lines = text.split("\n")
    out, stack, at = [], (), 0
    blocks = {s: (e, p) for s, e, p in chunk.blocks(lines)}
    end = 0
    for i in range(len(lines)):
        if i in blocks:
            end, stack = blocks[i]
        out.append((i in blocks, i < end, list(stack)))
        at += 1
    return out


def texts():
    rng = random.Random(11)
    out = ["", "\n", "a", "a\n===", "```\nx\n\n# no\n```\n# yes", "a\n---\n---\n---", "### deep\n## up\n# top\n### again", "~~~\n```\n~~~\nx"]
    return out + ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 4096])
def test_segments_change_nothing(spark, n):
    own = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)] + [(1000, None, "x"), (None, "a", "x")], "doc_id long, text string, lines string")
    got = {}
    for r in outline.line_outline(df, segment_lines=n).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(own)))
    for i, t in enumerate(own):
        assert [(r.begins, r.inside, r.heading_path) for r in got[i]] == expected(t), (n, t)
        assert "\n".join(t[r.start : r.start + r.n_chars] for r in got[i]) == t and [r.line_no for r in got[i]] == list(range(len(got[i])))


def test_sums_chain_like_reading(spark):
    rng = random.Random(12)
    for _ in range(300):
        lines = [rng.choice(LINES) for _ in range(rng.randint(2, 40))]
        cut = rng.randrange(1, len(lines))
        state, stack = outline.NORMAL, []
        for part, nxt in ((lines[:cut], lines[cut]), (lines[cut:], None)):
            state, stack = outline.chain(state, stack, outline.summary(part, nxt))
        want = []
        for last, _, _, h in outline.read(lines, outline.NORMAL, None):
            want = outline.put(want, h) if h else want
        assert stack == want and state.replace("p", "n") == last.replace("p", "n")
