import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import markup, patterns
from folioscan.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_variants_fold_alike(spark):
    for a, b in [("経", "經"), ("观", "觀"), ("仏", "佛"), ("国", "國"), ("譯", "译"), ("禅", "禪"), ("証", "證"), ("覚", "觉"), ("弥", "彌"), ("舎", "舍")]:
        assert one(spark, a, T.normalised) == one(spark, b, T.normalised) == T.python_normalised(a)


@pytest.mark.parametrize("text", ["Prajñā-pāramitā  Sūtra", "ΑΣ ας", "ﬁn ①", "བོད་སྐད།", "", "a_b c", "हिन्दी ा"])
def test_normal_forms_match_the_driver_s(spark, text):
    assert one(spark, text, T.normalised) == T.python_normalised(text)
    assert one(spark, text, T.normalised_spaces) == T.python_normalised_spaces(text)


def test_marks_separate_words_only_where_spaces_are_kept(spark):
    assert one(spark, "é b", T.normalised) == "eb"
    assert one(spark, "éa", T.normalised_spaces) == "e a"
    assert one(spark, "ā  b!", T.fold_ascii) == "a  b"


def bigrams(s):
    raw = s.encode()
    return {raw[i : i + 2] for i in range(len(raw) - 1)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), min_size=1, max_size=20))
def test_byte_jaccard_and_subsequence_models(spark, pairs):
    pairs = [(a.replace("\0", ""), b.replace("\0", "")) for a, b in pairs if not any(unicodedata.category(c) == "Cs" for c in a + b)]
    if not pairs:
        return
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.byte_jaccard(F.col("a"), F.col("b")).alias("j"), T.is_subsequence(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        x, y = bigrams(r["a"]), bigrams(r["b"])
        assert r["j"] == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)
        it = iter(r["a"])
        assert r["s"] == all(c in it for c in r["b"])


def test_token_jaccard(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), ("a b c", "b c d")], "a string, b string")
    got = [r[0] for r in df.select(T.token_jaccard(T.token_set(F.col("a")), T.token_set(F.col("b")))).collect()]
    assert got == pytest.approx([1 / 3, 0.0, 0.5])


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\nb\n", ["a", "b"]), ("a\r\nb\r\n", ["a", "b"]), ("\n\n", ["", ""]), ("a\n\nb", ["a", "", "b"])])
def test_lines(spark, text, want):
    assert one(spark, text, T.lines) == want


def test_plain_lines(spark):
    assert one(spark, "\n a  b \r\n\n\n\n c\n", T.plain_lines) == "a b\n\nc"
    assert one(spark, "a\r\n \n\n\nb ", T.trimmed_lines) == "a\n\nb"


def test_roman_and_numbers(spark):
    df = spark.createDataFrame([(0,), (4,), (1999,), (3999,), (4000,)], "n int")
    assert [r[0] for r in df.select(T.roman(F.col("n"))).collect()] == ["0", "IV", "MCMXCIX", "MMMCMXCIX", "4000"]
    assert one(spark, "DN 12.34 x 5", T.first_number) == "12" and one(spark, "a12b34c5", T.numbers) == ["12", "34"] and one(spark, "x", T.first_number) is None


def test_detect_source(spark):
    from folioscan.plans.registry import source_of

    ids = ["T0262", "t5", "DN1", "sn2.1", "s0101m.mul", "J01_0200B19", "sa_x", "2,7", "x", "", "J1_", "T"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x string").select(T.detect_source(F.col("x"))).collect()]
    assert got == [source_of(i) for i in ids] == ["cbeta", "cbeta", "tipitaka", "tipitaka", "tipitaka", "jozen", "gretil", "sat", None, None, None, None]


def test_small_predicates(spark):
    assert one(spark, "bkra shis", T.looks_like_ewts) and not one(spark, "བོད", T.looks_like_ewts) and not one(spark, "1 a", T.looks_like_ewts)
    assert one(spark, "J0012", T.is_text_number) and not one(spark, "J00123", T.is_text_number)
    assert one(spark, "0262, x", T.t_number) == "T0262" and one(spark, ", x", T.t_number) is None
    assert T.ensure_fields("a, b", ["b", "c"]) == ["a", "b", "c"] and T.escape_phrase('a"b\\', True) == '"a\\"b\\\\"'
    assert one(spark, " Dīgha sutta ", T.title_variants) == ["Dīgha sutta", "digha sutta", "diigha sutta", "Dīgha suttanta", "digha suttanta"]
    assert one(spark, "Ñāṇa Ṭīkā Saṅgīti Saṁ suttanta", T.title_variants)[2:4] == ["nyaana tiikaa sanggiiti sam suttanta", "Ñāṇa Ṭīkā Saṅgīti Saṁ suttantanta"]
    assert one(spark, "  ", T.title_variants) == []


def test_patterns(spark):
    assert patterns.compile_query("a b") == r"a\s*b" and patterns.compile_query("a.b c") == "a.b c" and patterns.compile_query("ab") == "ab"
    assert patterns.java_pattern("(") is None and patterns.java_pattern("(?=a)b") is None and patterns.java_pattern(r"(a)\1") is None
    p = patterns.java_pattern(patterns.compile_query("般若 経", variants=True, need_space=False))
    assert one(spark, "般若　經", lambda c: c.rlike(p))


TEI = """<TEI xmlns:cb="x"><teiHeader><title>Head</title><charDecl><char xml:id="C1"><charName>N</charName><mapping type="normal">n</mapping><mapping type="unicode">𠀀</mapping></char>
<char xml:id="C2"><charName>two</charName></char></charDecl></teiHeader><text><cb:juan n="001" fun="open"/><head>First &amp; <i>one</i></head><p>a<lb n="1"/>b<g ref="#C1"/><note>no<i>te</i> end</note>c<pb/>d<g ref="#C2"/></p><cb:juan n="001" fun="close"/>
<cb:juan n="002" fun="open"/><p>second</p><cb:juan n="002" fun="close"/></text></TEI>"""


def test_markup():
    assert markup.glyphs(TEI) == {"C1": "𠀀", "C2": "two"}
    assert markup.plain_text(TEI) == "First & onea\nb𠀀c\n\ndtwo\nsecond"
    assert "b𠀀 [注] note endc" in markup.plain_text(TEI, notes=True)
    assert markup.extract_text(TEI).startswith("Head") and markup.extract_text(TEI).endswith("twoFirst & onea b𠀀c dtwo second")
    assert markup.part_text(TEI, "2") == "second" and markup.part_text(TEI, "9") is None and markup.part_text(TEI, "1").endswith("dtwo")
    assert markup.nested_heads(TEI) == ["First & one"]
    assert markup.extract_text('x</p><g ref="#C1"/><p>y', glyph={"C1": "𠀀"}) == "x𠀀y"
    assert markup.visible_text("<p>a<script>no</script> &lt;b&gt;</p>") == "a <b>" and markup.title_and_heads("<title> t </title><h1>a<b>b</b></h1><h2>c</h2>") == ("t", ["ab", "c"])
    assert markup.plain_text(None) is None and markup.plain_text("") == ""


def test_normal_forms_of_every_character(spark):
    """What Spark translates itself equals the whole decomposition, for each character of the first planes, alone and among others."""
    chars = [chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1D400, 0x1F600, 0x2F800]]
    texts = ["".join(chars[i : i + 1]) for i in range(len(chars))] + [f"a{c}B b" for c in chars[0x80:0x3000]] + ["Ç ça É́x ǅ ΑΣ ς", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_replace(F.lower(T.nfkd(F.col("t"))), "ς", "σ")
    want = [F.regexp_replace(F.translate(whole, T._FOLD_FROM, T._FOLD_TO), f"[^{T.ALNUM}]", ""), F.trim(F.regexp_replace(whole, f"[^{T.ALNUM}]+", " ")), F.regexp_replace(whole, f"[^{T.ALNUM}]", "")]
    got = [T.normalised(F.col("t")), T.normalised_spaces(F.col("t")), T.normalised(F.col("t"), variants=False)]
    both = rows.select("t", F.array(*got).alias("got"), F.array(*want).alias("want")).filter("NOT got <=> want").collect()
    assert both == []


def test_references_without_a_semicolon_are_text():
    """A text that was cut off in a reference keeps its letters, as the pages' SQL has it."""
    assert markup.visible_text("<title>a &amp;&amp</title><p>b&ampc &lt; &notit; &#65; &</p>") == "a &&amp b&ampc < &notit; A &"
    assert markup.extract_text("<p>a &amp;&ampp{} &lt; &#65;</p>") == "a &&ampp{} < A"
    assert markup.nested_heads("<head>des &amp;&ampp</head>") == ["des &&ampp"]


def test_declarations_are_read_up_to_their_end(monkeypatch):
    """What follows the declarations of characters is not read for them; without any nothing is."""
    from folioscan.functions import markup

    declared = "<TEI><charDecl><char xml:id='G1'><mapping type='unicode'>u</mapping></char></charDecl>"
    read, events = [], markup.events
    monkeypatch.setattr(markup, "events", lambda xml: (read.append(e) or e for e in events(xml)))
    assert markup.glyphs(declared + "<g ref='#G1'/>" * 1000 + "</TEI>") == {"G1": "u"} and len(read) < 12
    read.clear()
    assert markup.glyphs("<p/>" * 1000) == {} and not read
    later = "<charDecl><char xml:id='G2'><charName>n</charName></char></charDecl>"
    assert markup.glyphs(declared + "<p>charDecl</p>" + later) == {"G1": "u", "G2": "n"}
