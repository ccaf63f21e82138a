"""A worker embeds few rows at once, however many a batch has."""

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from gazeloom.operators import vectors as V


class Frame:
    schema = T.StructType([T.StructField("t", T.StringType())])

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_frames_are_cut():
    texts = [f"word {n}" if n % 7 else "" for n in range(2500)]
    found = list(V.embed_columns(Frame(), {"v": ("t", 16)})(iter([pd.DataFrame({"t": texts})])))
    assert [len(f) for f in found] == [1024, 1024, 452]
    whole = pd.concat(found)
    assert list(whole.t) == texts
    encode = V.hashing_encoder(16)
    assert np.allclose(np.stack(whole.v), encode(texts))
