"""Small inputs with every odd case, and plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `key` string, th long, token long, n long, row long"

PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank and wait for rain"
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund während sieben weise Eulen vom alten Baum zusehen und auf den Regen warten"


def rows():
    near = PROSE.replace("lazy", "sleepy")
    texts = [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One  TWO"), (9, "12 34 !!"),
        (10, PROSE + "\n" + GERMAN), (11, "Überraschung"), (12, "x" * 3000), (13, " ".join(f"w{i % 50}" for i in range(5000))), (None, PROSE), (None, None),
        (14, GERMAN), (15, GERMAN + " heute"), (16, "a\r\nb\r\n" + PROSE), (16, "other text under one id"), (17, "日本語 テキスト 🙂 é  x　y"), (18, "\n\n\n"),
    ]
    return [(i, t, "de" if t and "der" in t.lower() else "en" if t else None, "s", len(t or ""), 0.5, "k", 7, 1, 2, 3) for i, t in texts]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def least_linked(texts, k, percent):
    """Index of texts -> the set of indices in its component."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            where[g].append(i)
    groups = defaultdict(set)
    for i in range(len(sets)):
        groups[root(i)].add(i)
    return [groups[root(i)] for i in range(len(sets))], [len(s) for s in sets]


def without_lines(entries):
    """[(key, text)], in order, to their texts without the lines that match an earlier one."""
    sets, where, out = [], defaultdict(list), {}
    for key, text in entries:
        if (key, text) in out:
            continue
        kept = []
        for line in (text or "").split("\n"):
            words = set(re.findall(r"[^ \t\n\x0b\f\r]+", line.lower()))
            shared = Counter(e for w in words for e in where[w])
            if not any(9 * n >= 4 * (len(words) + len(sets[e])) for e, n in shared.items()):
                kept.append(line)
            for w in words:
                where[w].append(len(sets))
            if words:
                sets.append(words)
        out[key, text] = None if text is None else "\n".join(kept)
    return out
