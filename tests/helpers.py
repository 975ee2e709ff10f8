"""What the tests share."""

DATA = "/root/testdata"


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return float(v) if hasattr(v, "quantize") else v


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
