import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vozlake.functions import frontend, numbers, phones
from vozlake.functions import text as tx


GOLDEN = [
    (
        "O CEP é 22290-160, o protocolo termina em 4-7-9, e o repasse é de R$ 1.350,90.",
        "O CEP é vinte e dois mil duzentos e noventa, cento e sessenta, o protocolo termina em quatro, sete, nove, e o repasse é de mil trezentos e cinquenta reais e noventa centavos.",
    ),
    ("Custa R$ 1,00 e o desconto é de 50%.", "Custa um real e o desconto é de cinquenta por cento."),
    ("Tinha 100 pessoas e 1000 ingressos.", "Tinha cem pessoas e mil ingressos."),
    ("Foram 2.000.000 de votos.", "Foram dois milhões de votos."),
    ("A taxa subiu 12,5%.", "A taxa subiu doze vírgula cinco por cento."),
    ("Sem número.", "Sem número."),
]


def test_numbers_in_words(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(GOLDEN)], "id int, text string")
    got = {r.id: r.spoken for r in numbers.verbalized(df).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [b for _, b in GOLDEN]
    counts = {r.rule: (r.matches, r.rows) for r in numbers.rule_counts(numbers.verbalized(df)).collect()}
    assert counts["currency"] == (2, 2) and counts["percent"] == (2, 2) and counts["integer"] == (2, 1)


@pytest.mark.parametrize(
    "n, words",
    [(0, "zero"), (100, "cem"), (101, "cento e um"), (160, "cento e sessenta"), (1000, "mil"), (1005, "mil e cinco"), (1300, "mil e trezentos"),
     (1350, "mil trezentos e cinquenta"), (22290, "vinte e dois mil duzentos e noventa"), (1000000, "um milhão"), (2_000_100, "dois milhões e cem"), (10**15, "um quatrilhão")],
)
def test_cardinals(spark, n, words):
    assert spark.range(1).select(numbers.cardinal(F.lit(str(n))).alias("w")).first().w == words
    assert spark.range(1).select(numbers.cardinal(F.lit("00" + str(n))).alias("w")).first().w == words


def test_numbers_beyond_all_scales_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "R$ 0,05 e 007"), (4, "a 12345678 b 1,0% x1y 3.000,50"), (5, "9" * 40 + ",5")], "id int, text string")
    got = {r.id: r.spoken for r in numbers.verbalized(df).collect()}
    assert got[1] is None and got[2] == ""
    assert got[3] == "zero reais e cinco centavos e sete"
    assert got[4].startswith("a um, dois, três, quatro, cinco, seis, sete, oito b um por cento x") and "xumy três mil,cinquenta" in got[4]
    assert got[5] == ", ".join(["nove"] * 40) + " vírgula cinco"


def test_counts_without_words(spark):
    rng = random.Random(31)
    bits = ["R$ ", "R$", "1", "23", "007", "4.500", "1.000.000", ",5", ",50", "%", " %", "-", "22290-160", "4-7-9", " ", " ", ".", "x", "1234567", "\u00a0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "sem"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: list(r.hits) for r in numbers.verbalized(df).collect()}
    assert {r.id: list(r.hits) for r in numbers.counted(df).collect()} == want
    assert sorted(map(tuple, numbers.rule_counts(numbers.counted(df)).collect())) == sorted(map(tuple, numbers.rule_counts(numbers.verbalized(df)).collect()))


def test_phones_with_and_without_word_edges():
    plain = phones.Speller(edges_match=False)
    assert plain.word("carioca") == ["k", "a", "ɾ", "i", "o", "k", "a"]
    assert plain.word("tarde") == ["t", "a", "χ", "dʒ", "i"]
    assert plain.word("mesmo") == ["m", "e", "ʒ", "m", "u"]
    assert plain.word("paz") == ["p", "a", "ʃ"]
    assert plain.word("falam") == ["f", "a", "l", "ãw̃"]
    assert plain.word("exame") == ["e", "z", "a", "m", "i"]
    edges = phones.Speller()
    assert edges.word("casa") == ["k", "a", "z", "ã"]
    assert edges.word("sapo") == ["z", "a", "p", "õ"]
    assert edges.word("brasil") == ["b", "ɾ", "a", "z", "i", "w"]
    assert set(p for w in ("manhã", "queijo", "guerra", "chuva", "lhama") for p in edges.word(w)) <= set(phones.INVENTORY)


def test_word_table_counts_each_word_once(spark):
    df = spark.createDataFrame([("A casa, a CASA!",), ("guarda-chuva",), (None,)], "text string")
    got = {r.word: (r.n, list(r.phones)) for r in phones.word_table(df).collect()}
    assert got["casa"] == (2, ["k", "a", "z", "ã"]) and got["a"][0] == 2 and {"guarda", "chuva"} <= set(got)
    whole = phones.text_phones(df).collect()
    assert list(whole[1].phones) == got["guarda"][1] + got["chuva"][1] and list(whole[2].phones) == []


def test_lexicon_keeps_capitals_and_whole_words(spark):
    df = spark.createDataFrame([(1, "Poxa, o dia na porta do SESC; diamante."), (2, "nada")], "id int, text string")
    lex = frontend.lexicon(spark, {"nada": "NADA", "Nada": "na.da"})
    got = {r.id: r.text for r in frontend.apply_lexicon(df, lex).collect()}
    assert got == {1: "Poʃa, o dʒi.a na poχta do Se.ski; diamante.", 2: "na.da"}
    many = lex.unionByName(spark.createDataFrame([(f"w{i}", "x", 100 + i) for i in range(frontend.LITERAL_LIMIT)], lex.schema))
    assert {r.id: r.text for r in frontend.apply_lexicon(df, many).collect()} == got


def plain_lexicon(text, entries):
    """Leftmost, then longest: entries tried at every place, in order of length."""
    known = {w.lower(): p for w, p in entries}
    word = lambda c: bool(c) and re.match(r"\w", c) is not None
    edge = lambda k: word(text[k - 1 : k]) != word(text[k : k + 1])
    out, k = [], 0
    while k < len(text):
        for w in sorted(known, key=len, reverse=True):
            if text[k : k + len(w)].lower() == w and edge(k) and edge(k + len(w)):
                out.append(known[w][0].upper() + known[w][1:] if text[k].isupper() else known[w])
                k += len(w)
                break
        else:
            out.append(text[k])
            k += 1
    return "".join(out)


def test_lexicon_takes_the_longest_phrase_from_the_left(spark):
    entries = [("por que", "purke"), ("por", "puʀ"), ("que nem", "kinẽ"), ("a b a", "aba"), ("b a", "ba"), ("a b a b", "abab"), ("guarda-chuva", "gwaʀda"), ("d'água", "dagwa"), ("etc.", "etɛ"), ("-feira", "fe"), ("... e", "i"), ("ß", "ss")]
    rng = random.Random(11)
    bits = ["por", "que", "nem", "Por", "a", "b", "A", "guarda", "chuva", "d", "água", "etc", "feira", "e", "ß", "x1", "_"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "-", "'", ". ", ".", "... ", "  ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", "...", "a b " * 2000, "por que", "Por que nem", texts[0], texts[0]]
    df = spark.createDataFrame([(k % 7, x) for k, x in enumerate([*texts, None])], "id int, text string").repartition(3)
    lex = spark.createDataFrame([(w, p, k) for k, (w, p) in enumerate([*entries, ("", "empty")])], "word string, phones string, seq long")
    want = sorted((plain_lexicon(x, entries) for x in texts))
    for limit in (256, 3):
        got = [r.text for r in frontend.apply_lexicon(df, lex, literal_limit=limit).collect()]
        assert got.count(None) == 1 and sorted(x for x in got if x is not None) == want
    none = lex.limit(0)
    assert sorted(r.text or "" for r in frontend.apply_lexicon(df, none).collect()) == sorted([*texts, ""])
    assert frontend.apply_lexicon(df.limit(0), lex).count() == 0


def test_front_end_modes(spark):
    df = spark.createDataFrame([(1, "  tio 2 ")], "id int, text string")
    assert [frontend.front_end(df, m).first().text for m in ("raw", "normalize", "lexicon")] == ["tio 2", "tio dois", "tʃi.o dois"]
    hooked = frontend.front_end(df, "raw", hook=lambda d, a, b: d.withColumn(b, F.upper(a)))
    assert hooked.first().text == "TIO 2"


def test_capitalize_like_a_character_walk(spark):
    texts = ["olá. tudo bem? sim… 12 anos. 3.5 é isso", "", "ß. a", "...já", "a"]

    def walk(text):
        out, cap = [], True
        for ch in text:
            out.append(ch.upper() if cap and ch.isalpha() else ch)
            cap = False if ch.isalpha() else cap
            cap = True if ch in ".?!…" else cap
        return "".join(out)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.capitalize_sentences(F.col("t"))).collect()] == [walk(t) for t in texts]


def test_fixed_rounds_like_python(spark):
    values = [35.05, 0.25, 0.35, 2.45, 12.0, 0.9999, 9.95, 1.005, 0.0, 15.45, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(tx.fixed(F.col("v"), 1).alias("a"), tx.fixed(F.col("v"), 3).alias("b"), tx.rounded(-F.col("v"), 1).alias("c")).collect()
    assert [(r.a, r.b) for r in got] == [(f"{v:.1f}", f"{v:.3f}") for v in values]
    assert [r.c for r in got] == [round(-v, 1) for v in values]


def test_small_text_rules(spark):
    df = spark.createDataFrame([(" Oi.  Tudo? fim… ok", "k=1, b = x=2 ,,", "Ana Lu", "Reunião 1")], "t string, kv string, u string, m string")
    r = df.select(
        tx.sentences(F.col("t")).alias("s"),
        tx.key_values(F.col("kv")).alias("kv"),
        tx.segment_id(F.col("u"), F.col("m"), F.lit(7)).alias("id"),
        tx.session_of_segment(F.lit("u-m_seg012")).alias("ses"),
        tx.heard_part(F.lit("um dois três quatro"), F.lit(0.5)).alias("h"),
        tx.style_prefix(F.lit("animado"), F.lit("zona-sul")).alias("p"),
        tx.style_prefix(F.lit("neutro"), F.lit(None).cast("string")).alias("q"),
        tx.strip_tags(F.lit("<a|b>  oi <x>")).alias("st"),
    ).first()
    assert r.s == ["Oi.", "Tudo?", "fim…", "ok"]
    assert [(x.name, x.value) for x in r.kv] == [("k", "1"), ("b", "x=2")]
    assert (r.id, r.ses, r.p, r.q, r.st) == ("ana-lu-reuni-o-1-seg007", "u-m", "<animado|zona-sul> ", "", "oi")
    assert r.h == "um dois … [interrompido pelo usuário]" and re.search("interrompido", r.h)


def test_accents_of_all_latin_letters(spark):
    letters = [chr(c) for c in range(0x20, 0xFFFF) if unicodedata.name(chr(c), "").startswith(("LATIN", "COMBINING ACUTE", "COMBINING TILDE"))]
    texts = [*letters, *(unicodedata.normalize("NFD", c) for c in letters), "São João, Ấn Độ, Čeština", "ｅ\u0301", "が"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", tx.strip_accents(F.col("text")).alias("t")).collect()}
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    assert [got[k] for k in range(len(texts))] == [plain(x) for x in texts]
