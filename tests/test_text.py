import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ids, vectors
from ledgerloom.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_terms():
    assert tx.keyword_terms(["a  b", "c　d"]) == ["a", "b", "c", "d"]
    assert tx.supports_trigrams(["abc", "日本語"]) and not tx.supports_trigrams(["abc", "ab"]) and not tx.supports_trigrams([])
    assert tx.like_pattern("50%_a\\") == "%50\\%\\_a\\\\%"


@pytest.mark.parametrize(("text", "term", "n"), [("aaaa", "aa", 3), ("thathat", "that", 2), ("ÉCOLE école", "école", 2), ("a.b a+b", "a.b", 1), ("", "x", 0), ("(x)", "(x)", 1)])
def test_occurrences_overlap(spark, text, term, n):
    assert value(spark, tx.occurrences(F.lit(text), term)) == n


def test_like_folds_ascii_only(spark):
    assert value(spark, tx.like_contains(F.lit("Été PAR"), "par")) and not value(spark, tx.like_contains(F.lit("ÉTÉ"), "été"))
    assert not value(spark, tx.like_contains(F.lit("axb"), "a_b"))


@pytest.mark.parametrize(("url", "want"), [
    ("git@Host.com:Team/Repo.git", "host.com/team/repo"), ("ssh://git@host.com:22/team/repo", "host.com/team/repo"), ("https://user@host.com/team/repo.git/", "host.com/team/repo"), ("/work/repo", ""), ("", ""), ("https://host.com/", ""), (" https://HOST.com/a?q#f ", "host.com/a"),
])
def test_canonical_repo(spark, url, want):
    assert value(spark, tx.canonical_repo(F.lit(url))) == want


@pytest.mark.parametrize(("alias", "given", "want"), [
    ("/work/a", "/work/a", True), ("/work/*", "/work/a", True), ("/work/*", "/work/a/b", False), ("git@h.com:a/b.git", "https://h.com/a/b", True), ("/w?rk", "/work", True), ("/[vw]ork", "/work", True), ("", "", False), ("/a.b", "/axb", False),
    ("re[^x]o", "reao", True), ("re[^x]o", "rexo", False), (r"r\*o", "r*o", True), (r"r\*o", r"r\zzo", False), ("[a-c]x", "bx", True), ("[c-a]x", "bx", False), ("[a", "[a", True), ("[a", "a", False), ("[]a]", "a", False), (r"[\]a]x", "]x", True), ("é*", "éa", True), ("a\n*", "a\nb", True), ("x?", "x/", False), ("[^a]", "/", True),
])
def test_aliases(spark, alias, given, want):
    row = spark.createDataFrame([(alias, given)], "a string, v string").withColumn("r", tx.glob_regex("a"))
    assert row.select(tx.alias_matches(F.col("a"), F.col("v"), F.col("r"))).first()[0] is want


def glob_by_hand(p, v):
    """Whether a glob matches, tried character by character; None if it is malformed."""
    if not p:
        return not v
    if p[0] == "*":
        rest = [glob_by_hand(p[1:], v[k:]) for k in range(len(v) + 1) if "/" not in v[:k]]
        return None if None in rest else any(rest)
    if p[0] == "[":
        k, negated, hit = 1, p[1:2] == "^", False
        k += negated
        first = True
        while first or p[k : k + 1] != "]":
            bounds = []
            while True:
                if p[k : k + 1] in ("", "-", "]"):
                    return None
                if p[k] == "\\":
                    k += 1
                    if k == len(p):
                        return None
                bounds.append(p[k])
                k += 1
                if len(bounds) == 1 and p[k : k + 1] == "-":
                    k += 1
                    continue
                break
            if k >= len(p):
                return None
            hit |= bool(v) and bounds[0] <= v[0] <= bounds[-1]
            first = False
        rest = glob_by_hand(p[k + 1 :], v[1:])
        return None if rest is None else bool(v) and hit != negated and rest
    one = p[0]
    if one == "\\":
        if len(p) == 1:
            return None
        p, one = p[1:], p[1]
    elif one == "?":
        rest = glob_by_hand(p[1:], v[1:])
        return None if rest is None else bool(v) and v[0] != "/" and rest
    rest = glob_by_hand(p[1:], v[1:])
    return None if rest is None else v[:1] == one and rest


def test_globs_against_brute_force(spark):
    """Many short globs over a small alphabet."""
    import random

    rng = random.Random(1)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(1, n)))
    rows = sorted({(make("ab/*?[]^-\\.", 6), make("ab/*.-]", 4)) for _ in range(4000)})
    got = spark.createDataFrame(rows, "a string, v string").withColumn("r", tx.glob_regex("a")).select("a", "v", F.coalesce(F.rlike("v", F.col("r")), F.lit(False)).alias("m")).collect()
    bad = [(r.a, r.v, r.m) for r in got if r.m != bool(glob_by_hand(r.a, r.v))]
    assert not bad and sum(r.m for r in got) > 50


@pytest.mark.parametrize(("source", "want"), [("https://h.com/Team/My_Repo.git", "my-repo"), ("/work/Ein Ding/", "ein-ding"), ("///", "unknown-subject"), ("日本", "unknown-subject")])
def test_slug(spark, source, want):
    assert value(spark, tx.slug(F.lit(source))) == want


def test_sets_and_links(spark):
    a = F.array(*map(F.lit, [" b", "a", "", "b ", "c0"]))
    assert value(spark, tx.set_normalize(a)) == ["a", "b", "c0"] and value(spark, tx.ordered_set(a)) == ["b", "a", "c0"]
    assert value(spark, tx.normalize_types(F.array(F.lit("[[x]]"), F.lit("x"), F.lit("[[ w ]]")))) == ["w", "x"]
    assert value(spark, tx.strip_wikilink(F.lit("[[ a b ]]"))) == "a b" and value(spark, tx.strip_wikilink(F.lit("a"))) == "a"


@pytest.mark.parametrize(("n", "want"), [(999, "999 tokens"), (1234, "1.2k tokens"), (123_456, "123k tokens"), (1_500_000, "1.5m tokens"), (250_000_000, "250m tokens")])
def test_token_counts(spark, n, want):
    assert value(spark, tx.format_token_count(F.lit(n))) == want


def test_byte_limits(spark):
    long = "ä" * 100 + "z" * 100
    cut = value(spark, tx.limit_both_ends(F.lit(long), 101))
    assert len(cut.encode()) <= 101 and cut.startswith("ä") and cut.endswith("z") and tx.RESPONSE_MARKER in cut
    assert value(spark, tx.limit_both_ends(F.lit("short"), 101)) == "short"
    assert tx.shorten_end("ä" * 20, 20) == "ää…[truncated]\n" and tx.shorten_end("ä" * 20, 10) == ""


def test_pages():
    text = [("user", "語" * 5000), ("assistant", ""), ("assistant", "x" * 14_400)]
    out = tx.pages(text)
    assert all(sum(len(c.encode()) for _, c in p) <= tx.PAGE_BYTES for p in out)
    assert "".join(c for p in out for r, c in p if r == "user") == "語" * 5000 and "".join(c for p in out for r, c in p if r == "assistant") == "x" * 14_400
    assert tx.pages([("user", "語語")], 1) == [[("user", "語")], [("user", "語")]] and tx.pages([]) == [[]]


def test_excerpt(spark):
    assert value(spark, tx.excerpt(F.lit("# Title\n\n  \n\n first \nline\n\nsecond"))) == "first \nline"
    assert value(spark, tx.excerpt(F.lit("# only"))) == "" and len(value(spark, tx.excerpt(F.lit("é" * 400))).encode()) == 500


def test_excerpts_of_all_documents(spark, tmp_path):
    """Headings and blank paragraphs are skipped, long paragraphs cut at 500 bytes between characters; every document has a row."""
    from ledgerloom.plans.queries import QUERIES

    texts = [None, "", "# only", "# Title\n\n \t\n\nbody \nline\n\nmore", "\n\nafter a blank", "plain", "a" * 501, "x" + "é" * 400, "## h\n\n" + "日本" * 300, "w " * 9000]

    def brute(t):
        parts = [p.strip(" \t\n\x0b\f\r") for p in (t or "").split("\n\n")]
        first = next((p for p in parts if p and not p.startswith("#")), "")
        while len(first.encode()) > 500:
            first = first[:-1]
        return first

    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.excerpt for r in QUERIES["excerpts"](spark, str(tmp_path)).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_ids(spark):
    import hashlib

    want = "fs-" + hashlib.sha256("\0".join([ids.ID_NAMESPACE, "claude", "s", "t"]).encode()).hexdigest()[:32]
    assert value(spark, ids.feedstock_id(F.lit("claude"), F.lit("s"), F.lit("t"))) == want
    assert value(spark, ids.session_from_path(F.lit("/x/rollout-2025-01-02T03-04-05-aaaa-bbbb-cccc-dddd-eeee.jsonl"))) == "aaaa-bbbb-cccc-dddd-eeee"
    assert value(spark, ids.session_from_path(F.lit("/x/abc.jsonl"))) == "abc"
    assert value(spark, ids.infer_agent(F.lit("/h/.codex/s.jsonl"))) == "codex" and value(spark, ids.infer_agent(F.lit("/h/s.jsonl"))) == "claude"
    assert value(spark, ids.path_within(F.lit("/a/b"), "/a/")) and not value(spark, ids.path_within(F.lit("/ab"), "/a"))


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, vectors.norm(a)) == 5 and value(spark, vectors.normalize(a)) == pytest.approx([0.6, 0.8]) and value(spark, vectors.cosine(a, a)) == pytest.approx(1)
    with pytest.raises(Exception, match="without length"):
        value(spark, vectors.normalize(F.array(F.lit(0.0))))


def test_bytes(spark):
    assert [value(spark, tx.format_bytes(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KiB", "3.0 MiB"]
