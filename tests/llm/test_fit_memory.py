"""What a shard's examples hold is a few bytes a character, copies without header included, and long files are judged in pieces."""

import tracemalloc

import numpy as np
import pandas as pd

from kelpline.llm import handwritten as H


def held(make):
    """(what make returns, bytes held after it, bytes at most)."""
    tracemalloc.start()
    try:
        return make(), *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_examples_hold_few_bytes():
    body = [f"def f{i}(a, b):\n" + f"    return [a + {i}, b]\n" * 150 for i in range(400)] + ["x = {1: 2}\n" * 3000]
    header, path = ["# by hand\n" if i % 2 else "" for i in range(401)], [f"src/f{i}.py" for i in range(401)]
    chars = sum(map(len, body))
    plain, now, _ = held(lambda: H.features(body, header, path))
    assert now < 6 * chars  # it was 16 bytes, and as many for a copy
    masked = np.flatnonzero(np.array(header) != "")
    both, now, _ = held(lambda: H.features(body, header, path, None, masked))
    assert len(both) == 401 + 200 and now < 6 * chars
    bare = H.features([body[i] for i in masked], [""] * 200, [path[i] for i in masked])
    for got, wanted in zip(both, [*plain, *bare], strict=True):
        assert np.array_equal(got[0], wanted[0]) and np.array_equal(got[1], wanted[1])


def test_long_files_are_judged_in_pieces():
    draw = np.random.default_rng(0)
    w = draw.normal(size=H.WIDTH + 1)
    texts = ["".join(map(chr, draw.integers(32, 127, 1 << 17))) for _ in range(40)]
    files = pd.DataFrame({"body": [*texts, "", "a = 1"], "header": [""] * 41 + ["# a\n"], "file_id": [f"a/{i}.py" for i in range(42)]})
    got, _, most = held(lambda: H.in_steps(files, w))
    assert most < 100 << 20  # at once it was 250 MB
    one = [H.margins([b], [h], [p], w)[0] for b, h, p in zip(files["body"], files["header"], files["file_id"])]
    assert np.allclose(got, one, atol=1 / H.MARGIN_STEPS)
    assert len(H.in_steps(files.iloc[:0], w)) == 0
