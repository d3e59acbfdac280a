"""Fixtures and plain Python versions of the corpus operators."""

from collections import defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra input columns.
CLASHES = ["key", "digest", "node", "comp", "size", "words", "_n", "bucket", "member", "taken", "score", "line", "kept", "word", "length"]

EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "a row without an id", "en", "b", 0),
    (None, None, None, "c", 0),
    (5, " \t\n\r ", None, "c", 5),
    (6, "Été à la plage, où il fait beau", "fr", "c", 5),
    (7, "x" * 200_000 + " " + "word " * 3000, "en", "b", 9),
    (8, "one two", "en", None, 9),
]


def edge_docs(spark, rows=EDGE_ROWS):
    """Rows with nulls, ties, repeats and long texts, and columns whose names clash."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, df.doc_id)
    return df


def words(text):
    return (text or "").encode().split()


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(docs):
    """doc_id -> smallest id reachable over pairs with 100 * intersection >= 75 * union."""
    root = {i: i for i, _ in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders, sets = defaultdict(list), {}
    for i, text in sorted(docs):
        s = shingles(text)
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        sets[i] = s
    return {i: find(i) for i in root}


def rows(df):
    return [r.asDict() for r in df.collect()]


def table(path, columns):
    import pyarrow.dataset as ds

    return ds.dataset(path).to_table(columns=columns).to_pylist()
