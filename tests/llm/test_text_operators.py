import random

import numpy as np
import pytest
import tiktoken

from corvane.llm import lookalikes as look
from corvane.llm.encoding import PATTERN, count_tokens, encode, load_ranks, merge_long, merge_short, vocabulary_path
from corvane.llm.packing import assign, pack
from corvane.llm.pii import checksum_ok, find_pii, finder, luhn, mod97, redact

PATH = vocabulary_path("byte_bpe_50k")
TEXTS = [None, "", " ", "a", "Hello  world<|endoftext|>!", "naïve café 日本 👩‍💻", "x" * 5000, "ab " * 3000, "\r\n\t\x00  "]
NAMES = (("Romwyn", "given"), ("Romara", "given"), ("Romos", "given"), ("Torwyn", "given"), ("Torara", "given"), ("Toros", "given"), ("Selwyn", "given"), ("Selara", "given"), ("Selos", "given"), ("Rose", "given"),
         ("Pellsen", "family"), ("Pellberg", "family"), ("Pellmann", "family"), ("Kronsen", "family"), ("Kronberg", "family"), ("Kronmann", "family"), ("Velsen", "family"), ("Velberg", "family"), ("Velmann", "family"))


def test_encoding_equals_the_library(spark):
    ranks = load_ranks(PATH)
    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    found = {r["doc_id"]: list(r["ids"]) for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids int"), "doc_id", "text", PATH).collect()}
    assert found == {i: public.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    counted = dict(tuple(r) for r in count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, ids int"), "doc_id", "text", PATH).collect())
    assert counted == {i: len(ids) for i, ids in found.items()}
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", PATH).count() == 0


def test_both_merges_agree():
    ranks, rng = load_ranks(PATH), random.Random(1)
    for _ in range(300):
        word = bytes(rng.choices(b"etaoinsh \xc3\xa9", k=rng.randint(1, 150)))
        assert merge_short(word, ranks) == merge_long(word, ranks)


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(k, rng.choice([0, None, 1, 5, 99, 100, 101, 250])) for k in range(500)]
    rows = [r.asDict() for r in pack(spark.createDataFrame(sizes, "doc_id bigint, tokens int"), "doc_id", 100, 7).collect()]
    load, tokens = {}, {}
    for r in rows:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
        if r["container_id"]:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 100 and tokens == {k: n or 0 for k, n in sizes} and len({(r["doc_id"], r["part"]) for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows if r["part"] > 0} == {k for k, n in sizes if (n or 0) > 100}
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens int"), "doc_id", 100, 7).count() == 0


def test_assignment_fills_containers():
    rng = np.random.default_rng(3)
    tokens = -np.sort(-rng.integers(1, 200, 4000))
    at = assign(tokens, 256)
    assert np.bincount(at, tokens).max() <= 256 and tokens.sum() / ((at.max() + 1) * 256) > 0.95


SAME = [("plain paper text", "plаin рарer text"), ("file office", "ﬁle oﬃce"), ("wide 2025!", "ｗｉｄｅ ２０２５！"), ("café", "café"), ("a b", "a b"), ("ab", "a​b"), ("re-do", "re‑do"), ("Kelvin", "Kelvin"), ("soft", "so­ft")]
OTHER = [("Paper", "paper"), ("cafe", "café"), ("x2", "x²"), ("a b", "a  b"), ("a\nb", "a b"), ("TM", "™"), ("R", "Ⓡ"), ("1/2", "½"), ("👩‍💻", "👩💻"), ("No", "№")]


def test_forms():
    form = look.Normalizer((("сор", 5), ("cop", 3), ("paper", 9))).text
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in OTHER:
        assert form(a) != form(b), (a, b)
    assert form("cop") == form("сор") == "сор" and form("рaper") == "paper" and form("") == ""
    assert look.SpellingTrie({"paper": 2}).reach("pater") == []


def test_vocabulary_settles_what_no_table_can():
    form = look.Normalizer((("paypal", 9), ("hello", 8), ("modern", 7), ("modem", 7), ("kilo", 5), ("Iran", 4))).text
    assert [form(w) for w in ("paypa1", "he11o", "heIlo", "hеӏӏo", "mo\u200bdem", "ｈｅｌｌｏ", "m0dern")] == ["paypal", "hello", "hello", "hello", "modem", "hello", "modern"]
    assert form("modern") != form("modem") and form("lran") == "lran" and form("2025") == "2025" and form("x1y0z1") == "x1y0z1"
    bare = look.Normalizer(()).text  # without a vocabulary only the table is left
    assert bare("paypa1") == "paypa1" and bare("heIlo") == "heIlo" and bare("hеӏӏo") == "hello"
    both = look.Normalizer((("fall", 5), ("faIl", 5), ("tall", 3), ("taIl", 3))).text
    assert both("fa11") == "fa11"  # two spellings that don't look the same: none is taken


def test_automaton_costs():
    trie = look.SpellingTrie({"paper": 2, "pager": 1, "cafés": 3})
    assert trie.reach("раp\u200ber") == [(0, 2, "paper")] and trie.reach("cafe\u0301s") == [(0, 3, "cafés")] and trie.reach("cafes") == []
    assert sorted(trie.reach("paxer", look.EDIT * 2))[0] == (look.EDIT * 2, 1, "pager") and trie.reach("paxer", look.BUDGET) == []
    assert trie.reach("pape", look.EDIT) == [(look.EDIT, 2, "paper")]


def test_identical_looking_pairs(spark):
    long = "A text of more than twelve characters"
    rows = [(1, long), (2, long.replace("o", "о")), (3, long), (4, "short"), (5, "ѕhort"), (6, None), (7, ""), (8, long + "!")] + [(100 + k, long.replace(" ", " ")) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    forms = look.text_forms(df, "doc_id", "text", 12, look.spellings(df, "text"))
    found = {tuple(r) for r in look.identical_looking(forms, "doc_id").collect()}
    copies = range(100, 190)
    assert {(1, 2), (2, 3)} <= found and {(k, c) for k in (1, 2, 3) for c in copies} <= found and len(found) == 2 + 270
    every = {tuple(r) for r in look.identical_looking(forms, "doc_id", copies=None).collect()}
    members = {r["doc_id"]: (r["text_key"], r["look_key"]) for r in look.looking_members(forms, "doc_id").collect()}
    assert every == {(a, b) for a in members for b in members if a < b and members[a][1] == members[b][1] and members[a][0] != members[b][0]}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert look.identical_looking(look.text_forms(empty, "doc_id", "text", 12, ()), "doc_id").count() == 0


FOUND = [
    ("Write to a.b @ example.com (cc x[at]post[dot]example[dot]org).", "email email"), ("me at post dot example dot org", "email"), ("look at the dot at the end", ""), ("Try left-grid@2.5.1, see https://f.example/@t/5550", ""),
    ("call (415) 555-0100 ext. 4 or +44 20 7946 0173", "phone phone"), ("text me, five five five, zero one nine five", "phone"), ("The score was 233-799-1447 there", ""), ("Телефон 8(000)102-95-14", "phone"),
    ("My SSN is 970138127.", "id_number"), ("Ticket 903-22-4227 is open", ""), ("Mi DNI es 23.119.249-I, sí", "id_number"), ("Die Charge 04 337 815 048 ist leer", ""), ("Steuer-ID 08 919 620 957", "id_number"),
    ("at 490 Cinder Rd., Apt 11C, Brastadt 69327", "address"), ("P.O. Box 713, Novhaven", "address"), ("Granitegasse 93b", "address"), ("31, impasse Falcon, 78839 Oststadt", "address"), ("ул. Ольховая, д. 22, кв. 82", "address"), ("Calle Juniper 96", "address"),
    ("Thanks to Romwyn E. Pellsen and K. Kronberg", "name name"), ("Pellmann, Toros", "name"), ("romos kronmann", "name"), ("the Rose compiler, Pellsen Labs, u/Romos_x, romos@", ""), ("Rose Velsen", "name"), ("Velara", ""), ("", ""),
]


@pytest.mark.parametrize(("text", "kinds"), FOUND)
def test_spans(text, kinds):
    assert " ".join(s.kind for s in finder(NAMES).spans(text)) == kinds


def test_found_and_redacted(spark):
    long = "word " * 20000 + "a@b.example"
    rows = [("f", "1", "Romwyn Pellsen, a@b.example, c@d.example"), ("f", "1", "Romwyn Pellsen, a@b.example, c@d.example"), ("f", "2", None), ("f", "3", ""), ("f", None, "a@b.example"), ("g", "4", long)]
    df = spark.createDataFrame(rows, "field_name string, record_id string, text string").selectExpr("*", "1 as seq")
    assert sorted(tuple(r) for r in find_pii(df, NAMES).collect()) == [("f", "1", "email", 1), ("f", "1", "email", 2), ("f", "1", "name", 1), ("g", "4", "email", 1)]
    out = [r["text"] for r in redact(df, NAMES).collect()]
    assert out[0] == "[NAME], [EMAIL], [EMAIL]" and out[2:4] == [None, ""] and out[5].endswith("word [EMAIL]")


def test_validators():
    assert luhn("79927398713") and not luhn("79927398710") and mod97("255081416802538") and not mod97("255081416802539")
    assert checksum_ok("12345678Z") and not checksum_ok("12345678A") and checksum_ok("112-233-445 95")
