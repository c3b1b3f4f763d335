from __future__ import annotations

import hashlib
import itertools
import random
import re
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmuration.functions import language as L
from murmuration.functions import text as X
from murmuration.operators import similarity
from murmuration.plans import catalogue
from murmuration.plans import text as plans


def one(spark, column, *values):
    names = [chr(97 + i) for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (X.strip_control, "a\x00b\tc\r\nd", "ab\tc\nd"),
        (X.unescape_html, "a &amp;lt; b &lt; c", "a &lt; b < c"),
        (X.strip_rt, "RT @some_user: hi", "hi"),
        (X.strip_urls, "see https://ex.org/a?b and www.ex.net now", "see   and   now"),
        (X.anonymise_mentions, "@abc hi a@b.c @d_e!", "@user hi a@b.c @user!"),
        (X.split_hashtags, "#StopTheWar #a_b", " Stop The War   a b "),
        (X.collapse_repeats, "soooo goood aab", "soo good aab"),
        (X.leet_decode, "v3ry b4dword mp3 covid19 ok", "very badword mp3 covid19 ok"),
        (X.leet_decode, "1diot, 1d10t! (h1b) 3rd 2nd w@tch|ng ab12345cd d1€ s1lly_", "idiot, 1d10t! (h1b) 3rd 2nd watchlng ab12345cd d1€ s1lly_"),
        (X.fix_confusables, "rаcist привет", "racist привет"),
        (X.strip_zero_width, "a​b‍c", "abc"),
        (X.join_spaced, "they k i l l it a b", "they kill it a b"),
        (X.nfkc, "ﬁn①", "fin1"),
        (X.normalise, "RT @a: See  https://x.org  #GoNow &amp; @bob", "see go now & @user"),
        (X.script, "привет мир ab", "cyrillic"),
        (X.script, "123", "unknown"),
        (X.dialect, "", "other"),
        (X.dialect, "yaar bhai accha", "hinglish"),
        (X.dialect, "the plain words of a long text", "sae"),
    ],
)
def test_function(spark, function, text, expected):
    assert one(spark, function, text) == expected


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "t string").select(*[f(F.col("t")).alias(f.__name__) for f in (X.normalise, X.leet_decode, X.collapse_repeats, X.strip_urls)]).first()
    assert all(v is None for v in row)


def test_shingles(spark):
    assert one(spark, lambda t: F.size(X.shingles(t)), "a b c d a b c") == 4
    assert one(spark, lambda t: X.shingles(t), "a b a") == ["a", "b"]


def test_language_profile(spark):
    scores = spark.createDataFrame([("der die das und ist nicht schön",)], "t string").select(X.profile_scores(F.col("t")).alias("s")).first().s.asDict()
    assert max(scores, key=scores.get) == "de"


def test_obfuscation_score(spark):
    score = X.obfuscation_score(F.lit(4), F.lit(1), F.lit(0), F.lit(0), F.lit(9), F.lit(0))
    assert spark.range(1).select(score.alias("x")).first().x == 1.0


@pytest.mark.parametrize("a, b, expected", [("ab", "ba", 1), ("kitten", "sitting", 3), ("abc", "abcdef", 3), ("", "", 0)])
def test_osa(a, b, expected):
    assert X.swap_distances(pd.Series([a]), pd.Series([b])).tolist() == [expected]


def test_swap_distances_equal_brute_force():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcß漢") for _ in range(r.randrange(8)))
    pairs = [(word(), word()) for _ in range(400)]
    found = X.swap_distances(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert found.tolist() == [brute_edits(a, b) for a, b in pairs]


def test_fuzzy_hits(spark):
    words = spark.createDataFrame([("muzlax",), ("hte",), ("exmaple",), ("example",)], "word string")
    lexicon = spark.createDataFrame([("muslax",), ("example",)], "term string")
    found = {r.word: (r.term, r.distance) for r in similarity.fuzzy_hits(words, lexicon).collect()}
    assert found == {"muzlax": ("muslax", 1), "exmaple": ("example", 1)}
    common = spark.createDataFrame([("muzlax",)], "word string")
    assert {r.word for r in similarity.fuzzy_hits(words, lexicon, common=common).collect()} == {"exmaple"}


def test_fuzzy_hits_are_brute_force(spark):
    r = random.Random(7)
    made = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(4, 11)))
    terms, words = {made() for _ in range(60)} | {"two words"}, {made() for _ in range(500)}
    near = {}
    for w in words - terms:
        found = [(brute_edits(w, t), t) for t in terms if len(t) >= 5 and " " not in t and t[0] in w[:2] and brute_edits(w, t) <= (1 if len(w) < 8 else 2)]
        if len(w) >= 5 and found:
            near[w] = min(found)
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    got = similarity.fuzzy_hits(frame(words, "word"), frame(terms, "term")).collect()
    assert {x.word: (x.distance, x.term) for x in got} == near and len(near) > 20


def test_fuzzy_repair_of_whole_documents(spark):
    docs = [(1, "A Muzlax, the exmaple! exmaple's muzlax_ muslax", 0.9), (2, "nothing here", 0.2), (3, None, None), (4, "", 0.0), (5, "exmaple " * 5_000, 0.0)]
    lexicon = spark.createDataFrame([("muslax",), ("example",)], "term string")
    got = {r.id: (r.repaired, r.n_hits, r.score) for r in similarity.fuzzy_repair(spark.createDataFrame(docs, "id long, t string, s double"), lexicon, "id", "t", "s").collect()}
    assert got[1] == ("A muslax, the example! example's muzlax_ muslax", 2, 1.0)
    assert got[2] == ("nothing here", 0, 0.2) and got[3][:2] == (None, 0) and got[4] == ("", 0, 0.0)
    assert got[5] == ("example " * 5_000, 1, 0.15)


def test_duplicates_point_at_earlier_ones(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base, "x"])), (4, "other words entirely here"), (5, "")]
    found = {r.id: r.duplicate_of for r in similarity.duplicates_of(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert found == {2: 1, 3: 1}


def test_language_verdicts(spark):

    texts = ["the cat is on the mat and it was all of us", "привет мир", "", "yaar kya hai yeh sab bahut galat", "ana mesh 3ayez el kalb da", "der hund ist nicht die katze", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", L.detect(F.col("t")).alias("v"))
    found = {r.i: r.v for r in rows.collect()}
    assert [found[i].lang for i in range(6)] == ["en", "ru", "und", "hi", "ar", "de"]
    assert found[3].romanised and found[4].romanised and not found[0].romanised and found[5].confidence > 0.6
    moved = L.transliterate(F.col("t"), F.col("v.lang"), F.coalesce(F.col("v.romanised"), F.lit(False)), {"yaar": "यार"}, {"ana": "أنا"})
    moved = {r.i: r.x for r in rows.select("i", moved.alias("x")).collect()}
    assert moved[0] == texts[0] and "यार kya" in moved[3] and moved[6] is None
    assert moved[4] == "أنا mesh عايز الكالب da"


def test_marks_outside_words_give_no_bonus(spark):
    rows = spark.createDataFrame([("¿the ¡and",), ("señor",)], "t string").select(X.profile_scores(F.col("t"))["es"].alias("es")).collect()
    assert [r.es for r in rows] == [0.0, 0.1]


def test_segments_take_the_commonest_words():

    costs = L.word_costs(["the", "a", "now", "here", "nowhere", "war", "stop"])
    found = {w: L.segment(w, costs) for w in ("stopthewar", "nowhere", "stopxyzthe", "qqqqzzzz", "ab", "स्टॉप", "THEwar")}
    assert found == {"stopthewar": "stop the war", "nowhere": "nowhere", "stopxyzthe": "stop xyz the", "qqqqzzzz": "qqqqzzzz", "ab": "ab", "स्टॉप": "स्टॉप", "THEwar": "the war"}


def test_emoji_and_hashtags(spark):

    row = spark.createDataFrame([("go 🔥!", "#stopthewar #BigNews #a_b #ünï"), (None, None)], "e string, h string").select(L.emoji_named(F.col("e")).alias("e"), L.split_hashtags(F.col("h"), ["stop", "the", "war"]).alias("h")).collect()
    assert row[0].e.text == "go  fire !" and row[0].e.emoji == ["🔥"] and row[0].h == "stop the war big news a b ünï"
    assert row[1].h is None


def stored(spark, folder, texts):
    """The folder, with the texts as `documents`; ids of each remainder by 4 appear."""
    spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def dirty(i, t):
    return [f"RT @user{i}: {t}", f"see https://ex.org/{i} &amp; {t}", f"{t} @name_{i} sooooo", f"{t} v3ry b4dword www.ex.net"][i % 4]


ODD = ["plain words", "ÀÀÀ éééé AAAA 11112222 ____", "aaa\nbbbb", "漢漢漢漢", "rаcist words of one text", "they k i l l it", "zero​width​here", "v1le\nw0rds", "", "привет мир", "k.i.l.l s0me соrрse fiiiine", "a­b⁠c​d‎e‏f⁡g"]


def test_collapse_repeats_of_all_documents(spark, tmp_path):
    made = plans.collapse_repeats(spark, stored(spark, tmp_path / "t", ODD))
    brute = lambda t: re.sub(r"(\w)\1{2,}", r"\1\1", t)
    assert {r.doc_id: r.collapsed_sha256 for r in made.collect()} == {i: hashlib.sha256(brute(dirty(i, t)).encode()).hexdigest() for i, t in enumerate(ODD, 100)}


def brute_leet(text):
    """The text decoded, and how many tokens were."""
    signs, n = "@$!|+€£", 0
    word = lambda c: c.isalnum() or c == "_"

    def run(m):
        nonlocal n
        r = m[0]
        for start in (i for i, c in enumerate(r) if word(c) and (i == 0 or not word(r[i - 1]))):
            end = next((i for i in range(start, len(r)) if not word(r[i])), len(r))
            head, after = r[start:end], r[end : end + 1]
            if any("a" <= c.lower() <= "z" for c in head) and (after or any("0" <= c <= "9" for c in head)):
                token = r[start:].rstrip(signs)
                plain = "".join(X.LEET.get(c, c) for c in token.lower())
                digits = sum(not c.isalpha() for c in token)
                shape = re.fullmatch(r"(?i)[a-z]{1,3}\d{2,}|\d+[a-z]{1,2}|\w*\d{4,}\w*|[a-z]+\d{1,2}", token)
                if len(token) >= 3 and plain.isalpha() and not shape and 1 <= digits <= len(token) // 2 and len(plain) >= 4 and re.search("[aeiouy]", plain):
                    n += 1
                    return r[:start] + plain + r[start + len(token) :]
                return r
        return r

    return re.sub(rf"[\w{re.escape(signs)}]+", run, text), n


def test_leet_decode_is_brute_force(spark, tmp_path):
    r = random.Random(2)
    texts = ["".join(r.choice("aeitsAZ0134579@$!|+€ _-é漢") for _ in range(r.randrange(40))) for _ in range(400)] + ["v1le, w0rds", "1diot mp3", "known x0x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: (x.d, x.n) for x in rows.select("i", X.leet_decode(F.col("t")).alias("d"), X.leet_count(F.col("t")).alias("n")).collect()}
    assert got == {i: brute_leet(t) for i, t in enumerate(texts)}
    known = rows.where("i >= 400").select("i", X.leet_decode(F.col("t"), ["mpe", "xox"]).alias("d")).collect()
    assert {x.i: x.d for x in known} == {400: "vile, words", 401: "idiot mpe", 402: "known xox"}


def brute_score(t):
    x = "".join(c for c in t if c not in X.ZERO_WIDTH)
    zero = len(t) - len(x)
    words, odd = [], 0
    for w in re.split(r"\s", unicodedata.normalize("NFKC", x)):
        latin, like = sum(c.isascii() and c.isalpha() for c in w), sum(c in X.CONFUSABLE for c in w)
        fits = latin and like and latin + like == len(w) and like <= max(1, len(w) // 2)
        odd += bool(fits)
        words.append("".join(X.CONFUSABLE.get(c, c) for c in w) if fits else w)
    spaced = re.compile(r"(?<!\w)(?:[^\W\d_][\s.\-_*]){2,}[^\W\d_](?!\w)")
    x = " ".join(words)
    n_spaced = len(spaced.findall(x))
    x, leet = brute_leet(spaced.sub(lambda m: re.sub(r"[\s.\-_*]", "", m[0]), x))
    repeats = len(re.findall(r"(\w)\1{2,}", x))
    return min(1.0, (leet + 1.5 * odd + n_spaced + 0.6 * min(zero, 5) + 0.3 * repeats) / (max(1, len(x.split())) ** 0.5 + 1))


def test_obfuscation_score_counts_five_signals(spark, tmp_path):
    texts = [f"{t} {'word ' * n}" for t in ODD for n in (0, 30, 31, 32)]
    made = {r.doc_id: r.score for r in plans.obfuscation_score(spark, stored(spark, tmp_path / "t", texts)).collect()}
    assert made == pytest.approx({i: brute_score(dirty(i, t)) for i, t in enumerate(texts, 100)}, abs=6e-5)


def brute_edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_join_takes_all_letters_and_swaps(spark, tmp_path):
    words = "réation raetion reatoin erationn Ertiönen ertionenß thanér htaner stntrе stnter reation ouenth ouénht edwhrén ingthandïs idiótt idoitt äouenth other réatión"
    hits = {}
    for w in {w.lower() for w in words.split()} - set(plans.TERMS):
        near = [(brute_edits(w, t), t) for t in plans.TERMS if t[0] in w[:2] and brute_edits(w, t) <= (1 if len(w) < 8 else 2)]
        if len(w) >= 5 and near:
            hits[w] = min(near)
    made = plans.fuzzy_lexicon_join(spark, stored(spark, tmp_path / "t", [words, words]))
    assert {r.word: (r.distance, r.term) for r in made.collect()} == hits and {"réation", "raetion", "ertiönen"} <= set(hits)


def test_fuzzy_join_measures_as_its_sql(spark, tmp_path):
    words = "reatonin reatorin reatouin raetion reatxoi thnaer anbter"
    path = stored(spark, tmp_path / "t", [words])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = set(con.execute(catalogue.oracle_sql()["fuzzy_lexicon_join"]).fetchall())
    assert {tuple(r) for r in plans.fuzzy_lexicon_join(spark, path).collect()} == want and ("reatonin", "reation", 2) in want


def test_damerau_distances_equal_the_recursion():
    def brute(a, b):
        far = len(a) + len(b)
        d, last = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}, {}
        for i in range(1, len(a) + 1):
            left = 0
            for j in range(1, len(b) + 1):
                k, m = last.get(b[j - 1], 0), left
                left = j if a[i - 1] == b[j - 1] else left
                moved = d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) if k and m else far
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, moved)
            last[a[i - 1]] = i
        return d[len(a), len(b)]

    r = random.Random(5)
    pairs = [("".join(r.choice("abcß") for _ in range(r.randrange(8))), "".join(r.choice("abcß") for _ in range(r.randrange(8)))) for _ in range(600)]
    assert X.damerau_distances(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).tolist() == [brute(a, b) for a, b in pairs]


def test_all_pairs_of_a_band_follow_from_lsh_candidates(spark, data):
    count, width = similarity.banding(0.8)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    keyed = similarity.bands(similarity.signatures(docs, "doc_id", "text", hashes=count * width), "doc_id", count, width).collect()
    by = {}
    for r in keyed:
        by.setdefault(r.band, set()).add(r.doc_id)
    want = {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}
    found, heads = {}, {}
    for r in plans.lsh_candidates(spark, data).collect():
        found.setdefault(r.band, set()).add(r.doc_id)
        heads[r.band] = r.candidate
    assert {p for ids in found.values() for p in itertools.combinations(sorted(ids), 2)} == want and want
    assert all(heads[b] == min(ids) for b, ids in found.items())
    links = {tuple(sorted((r.doc_id, r.duplicate_of))) for r in similarity.duplicates_of(docs, "doc_id", "text").collect()}
    assert links and len(links & want) >= 0.9 * len(links)  # of exact links; one in a million is let go


def test_bands_follow_from_the_threshold():
    for t in (0.3, 0.5, 0.8, 0.95):
        count, width = similarity.banding(t)
        assert count * width <= similarity.HASHES and (1 - t**width) ** count <= similarity.MISS
    assert similarity.banding(1.0) == (1, similarity.HASHES)


def brute_emoji(text, listed):
    """All ways to cut a text into emoji and single signs; the one whose emoji are longest from the left."""
    tone, ri = {"🏻": "light", "🏼": "medium-light", "🏽": "medium", "🏾": "medium-dark", "🏿": "dark"}, lambda c: 0x1F1E6 <= ord(c) <= 0x1F1FF

    def named(s):
        if s in listed:
            return listed[s]
        if len(s) == 2 and all(map(ri, s)):
            return "flag " + "".join(chr(ord(c) - 0x1F1E6 + 97) for c in s)
        if len(s) == 1 and ri(s):
            return "regional indicator " + chr(ord(s) - 0x1F1E6 + 97)
        if re.fullmatch("[0-9#*]\ufe0f?\u20e3", s):
            return f"keycap {s[0]}"
        parts = s.split("\u200d")
        names = []
        for i, p in enumerate(parts):
            m = re.fullmatch("([🀀-🇥🌀-🫿☀-➿])(\ufe0f?)([🏻-🏿]?)", p)
            if not m or (m[1] in tone and m[3]):
                return None
            names.append(unicodedata.name(m[1]).lower() + (f" {tone[m[3]]} skin tone" if m[3] else ""))
        return " with ".join(names)

    out, found, i = "", [], 0
    while i < len(text):
        best = max((j for j in range(i + 1, len(text) + 1) if named(text[i:j])), default=None)
        if best is None:
            out, i = out + text[i], i + 1
        else:
            out, found, i = out + f" {named(text[i:best])} ", [*found, text[i:best]], best
    return out, found


def test_emoji_sequences_are_brute_force(spark):
    r = random.Random(12)
    pool = ["👩", "👩🏽", "👨", "\u200d", "💻", "❤\ufe0f", "❤", "🏻", "🏿", "👍", "🇩", "🇪", "🇫", "1", "#", "\ufe0f", "\u20e3", "a", " ", "🏳\ufe0f\u200d🌈", "é", "漢"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(9))) for _ in range(600)] + ["family 👨\u200d👩\u200d👧\u200d👦!", "🇩🇪🇫🇷 5\ufe0f\u20e3", "plain", ""]
    trie = L.EmojiTrie(L.SEQUENCES)
    for t in texts:
        assert trie.name_all(t) == brute_emoji(t, L.SEQUENCES), t
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", L.emoji_named(F.col("t")).alias("e")).collect()
    assert {x.i: (x.e.text, x.e.emoji) for x in rows} == {i: brute_emoji(t, L.SEQUENCES) if t is not None else (None, []) for i, t in enumerate([*texts, None])}
    assert trie.name_all("🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f")[0] == " flag gbeng "


def test_the_whole_cleaning_chain(spark):
    text = "RT @a: See  https://x.org  #stopthewar &amp; @bob 👍🏽 ﬁn"
    assert one(spark, lambda t: L.normalise(t, ["the", "stop", "war"]), text) == "see stop the war & @user thumbs up sign medium skin tone fin"


def test_obfuscation_score_takes_texts_in_small_batches(spark, data):
    """an Arrow batch holds 10,000 whole texts, of which Python makes several copies."""
    plan = plans.obfuscation_score(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_normalise_takes_texts_in_small_batches(spark, data):
    """as above, also with words for hashtags."""
    made = spark.read.parquet(f"{data}/documents.parquet").select(L.normalise(F.col("text"), ["stop", "war"]))
    for df in (plans.normalize_text(spark, data), made):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
