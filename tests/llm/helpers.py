"""What the tests of the corpus operators share."""

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(k, t, *(more or ("en", "web")), len(t) if t else None) for k, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA)


def groups_of(ids, links):
    """The smallest identifier that each one reaches."""
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}
