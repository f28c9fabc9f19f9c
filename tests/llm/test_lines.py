import random

from foliospark.llm import lines
from tests.llm.data import SF, docs, empty, without_lines


def check(table):
    entries = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    # one line order for all: key, then line number, then text hash; here no two texts of a key share lines
    want = without_lines(sorted(entries, key=lambda e: (e[0] is not None, e[0] or 0)))
    got = lines.dedup(table).collect()
    assert len(got) == len(entries)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, ((k, want[k, t]) for k, t in entries)))
    return got


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    got = check(docs(spark))
    assert {r.n_lines for r in got if r.text is None} == {0}


def test_variants_around_the_threshold(spark):
    r = random.Random(9)
    base = [[f"t{r.randrange(300)}" for _ in range(n)] for n in (3, 4, 5, 9, 20, 60)]
    texts = []
    for i in range(60):
        out = []
        for _ in range(3):
            line = list(r.choice(base))
            for j in range(len(line)):
                if r.random() < 0.08:
                    line[j] = f"u{r.randrange(40)}"
            r.shuffle(line)
            out.append(" ".join(line) if r.random() < 0.9 else "\t".join(line))
        texts.append((i, "\n".join(out)))
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))


def test_empty(spark):
    assert lines.dedup(empty(spark)).collect() == []


def test_a_large_group_of_near_lines_makes_few_pairs(spark, monkeypatch):
    r = random.Random(4)
    base = [f"t{i}" for i in range(40)]
    far = [f"s{i}" for i in range(30)]
    texts = []
    for i in range(400):
        near = [w if r.random() > 0.03 else f"u{r.randrange(10**6)}" for w in base]
        half = [w if r.random() > 0.12 else f"v{r.randrange(10**6)}" for w in far]  # hardly any two of these match
        texts.append((i, " ".join(near) + "\n" + " ".join(half)))
    made, near_ = [], lines._near

    def counted(*args):
        out = near_(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(lines, "_near", counted)
    monkeypatch.setattr(lines, "SHARED", 32)
    monkeypatch.setattr(lines, "FEW", 300)
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert made and made[0] <= 5 * 800  # the first round; 400 near lines have 79,800 pairs
    assert sum(made) < 0.5 * 79_800


def test_sets_are_kept_in_tables_that_go(spark, monkeypatch):
    kept, tables, saved, stored, discard = [], [], lines.saved, lines.stored, lines.discard

    def note(df):
        kept.extend(df.columns)
        return saved(df)

    def table(df):
        tables.append(out := stored(df))
        return out

    monkeypatch.setattr(lines, "saved", note)
    monkeypatch.setattr(lines, "stored", table)
    monkeypatch.setattr(lines, "discard", lambda t: (discard(t), tables.remove(next(x for x in tables if x is t))))
    check(docs(spark))
    assert not {"x", "prefix", "w"} & set(kept)  # sets and their words are not checkpointed, which takes more disk
    assert tables == []

def test_only_wanted_lines_are_moved_for_verification(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**9)}"
    first = [" ".join(word() for _ in range(12)) for _ in range(20)]
    texts = [(i, "\n".join([first[i % 20] + " " + word(), *(" ".join(word() for _ in range(12)) for _ in range(30))])) for i in range(40)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    moved, whole = [], lines._whole

    def noted(wanted, docs, key, text):
        out = whole(wanted, docs, key, text)
        moved.append((wanted.count(), lines._wanted_lines(wanted.select("o", "at.*"), docs, key, text).count()))
        return out

    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(lines, "_whole", noted)
    check(table)
    assert moved and all(n <= w + 5 for w, n in moved)  # before, all 1,240 lines of those texts
