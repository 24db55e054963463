import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with two further columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return WORD.findall(text or "")


def components(items, linked):
    """Smallest reachable id for each id; linked(a, b) on all pairs."""
    up = {i: i for i in items}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(items)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
