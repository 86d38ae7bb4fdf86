"""Comparison of a Spark result with an oracle's."""

import math


def rows(pdf):
    """Rows as sorted tuples, columns by name; numbers to ten digits."""

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return float(f"{float(v):.10g}")
        return str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False, name=None)), key=repr)


def same(spark_df, duck_rel):
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert x == y, (len(x), len(y), [r for r in x if r not in y][:3], [r for r in y if r not in x][:3])
    return len(x)
