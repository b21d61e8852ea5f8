"""Crowded parts of a dialogue keep their order."""

import random
from collections import defaultdict

from quire.llm import chat


def test_slices_keep_the_order(frame):
    r = random.Random(4)
    rows = [(None, r.choice([None, 0, 1, 2]), r.choice(["user", "assistant", "system"]), f"m{r.randrange(40)}") for _ in range(300)]
    rows += [(1, 0, "user", "same")] * 50 + [(1, 1, "assistant", "b"), (2, 0, "user", "alone")]
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string")

    def whole(slice_rows):
        out = defaultdict(str)
        for x in chat.rotate(df, slice_rows=slice_rows).orderBy("conv_id", "perspective", "part", "slice").collect():
            assert x["n_messages"] <= slice_rows and x["start_char"] == len(out[x["conv_id"], x["perspective"]])
            out[x["conv_id"], x["perspective"]] += x["text"]
        return out

    assert whole(8) == whole(7) == whole(10_000)
