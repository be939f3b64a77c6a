import random

import pytest

from loomgraph.llm import garbled as g

CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("cp1252", "cp437"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("cp932", "cp1252"), ("euc_jp", "cp1252")]
LINES = [
    "La méthode relit le fichier avant que la classe ne soit créée. Où est déclaré le paramètre {n} ?",
    "Für größere Verzeichnisse empfiehlt sich eine höhere Grenze als {n}, die Abhängigkeit heißt sonst überzählig.",
    "La función también devuelve {n} después del análisis léxico; así la búsqueda continúa en el módulo.",
    "Функция сначала читает файл номер {n}, а затем обновляет каждый узел графа заново.",
    "索引が古い場合は {n} を再解析してください。各ノードは最大の辺を持ちます。関数は索引を読み込みます。",
    "Mỗi nút trong đồ thị có tối đa {n} cạnh đi ra và được xếp hạng theo điểm số.",
    "The reviewer’s note says “unit {n}” — not “shared unit”, see § {n} for 5 µs… and the café.",
]


def decode(text, right, wrong):
    raw = text.encode(right)
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    return [(i, "\n".join(rnd.choice(LINES).format(n=rnd.randrange(900)) for _ in range(4)), "x") for i in range(600)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return g.train(spark.createDataFrame(corpus, "doc_id long, text string, restored string"))


def test_held_out_lines_come_back(model):
    rnd, n, good = random.Random(12), 0, 0
    for right, wrong in CHAINS:
        for line in LINES:
            text = line.format(n=rnd.randrange(900))
            try:
                bad = decode(text, right, wrong)
            except UnicodeEncodeError:
                continue
            if bad == text:
                continue
            n += 1
            good += g.inspect(bad, model, {})[1] == text
    assert n > 40 and good >= 0.95 * n


def test_garbled_twice(model):
    text = LINES[1].format(n=3)
    twice = decode(decode(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    hit, fixed, chains, lost = g.inspect(twice, model, {})
    assert hit and fixed == text and not lost


def test_clean_lines_stay(model):
    rnd = random.Random(13)
    for line in LINES * 30:
        text = line.format(n=rnd.randrange(900))
        assert g.inspect(text, model, {}) == (False, text, [], False)


@pytest.mark.parametrize("text", ['When a page shows "Ã©" instead of "é", the reader picked the wrong codec.', "With errors='replace' bad bytes turn into '\ufffd', see the notes.", "The test feeds 'â€™' on purpose."])
def test_examples_are_no_cases(model, text):
    assert not g.inspect(text, model, {})[0]


def test_lost_characters(model):
    hit, _, _, lost = g.inspect("Die Abh\ufffd\ufffdngigkeit fehlt.", model, {})
    assert hit and lost


def test_spark(spark, corpus, model):
    bad = decode(LINES[0].format(n=1), "utf-8", "cp1252")
    rows = [*corpus, (1000, bad, None), (1001, None, None), (1002, "", None), (1003, "plain ascii", None), (1004, "clean é\n" * 5 + bad, None), (1000, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = g.garbled(df, model=model).collect()
    assert sorted(r.doc_id for r in got) == [1000, 1000, 1004]
    assert {r.restored.split("\n")[-1] for r in got} == {LINES[0].format(n=1)}
    assert g.garbled(df.limit(0)).count() == 0


def test_letters_lost_as_question_marks(model):
    assert g.inspect("??c iterator t? t?p c?u h?nh r?i tr? v? danh s?ch", model, {})[::3] == (True, True)
    for text in ["Is it so? Yes", "see http://x/a?b=c and http://x/a?d=e", "x = a?b:c; y = d?e:f", "colou?r matches both"]:
        assert not g.inspect(text, model, {})[0]


@pytest.mark.parametrize("text", [
    "L'index relit le fichier m?thode.",  # one word, known with another letter
    "La m??thode relit le fichier.",  # UTF-8 bytes replaced one by one
    "M?i nút trong d? li?u có t?i đa ba c?nh.",  # beside letters that were kept
    "??????? ??????? ?????? ????.",  # words of marks alone
    "The note says ????????????.",
])
def test_letters_lost_on_any_line(spark, model, text):
    assert g.inspect(text, model, {})[::3] == (True, True)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.doc_id, r.lost) for r in g.garbled(df, model=model).collect()] == [(1, True)]


@pytest.mark.parametrize("text", ["Est-ce que la méthode relit le fichier ? Où est-il ?", "a ?? b and c ?? d", "What??? Really??", "TODO: ??? later", "https?://x and colou?r", "Is it là? oui, là? non", "a codec that writes 'm?thode' for it"])
def test_question_marks_that_stay(model, text):
    assert not g.inspect(text, model, {})[0]


MIXED = [
    ("Функция сначала читает файл", "cp1251", "cp1252", "→ {} ✓"),  # beside characters that the codec lacks
    ("Функция сначала читает файл", "cp1251", "cp1252", "La méthode relit le fichier avant que la classe ne soit créée. {} 索引"),
    ("索引が古い場合は再解析してください", "cp932", "cp1252", "Функция сначала читает файл номер 7, а затем обновляет каждый узел графа заново. {} Функция"),
    ("関数は", "utf-8", "cp932", "Функция сначала читает файл номер 7, а затем обновляет каждый узел графа заново. {}"),
    ("La méthode relit le fichier avant que la classe", "cp1252", "gbk", "{}"),  # a single-byte encoding read as a double-byte one
    ("各ノードは最大の辺を持ちます", "euc_jp", "gbk", "{}"),
]


@pytest.mark.parametrize("text, right, wrong, around", MIXED)
def test_stretch_of_another_encoding(model, text, right, wrong, around):
    bad = text.encode(right).decode(wrong, errors="replace") if wrong in g.DOUBLE else decode(text, right, wrong)
    if "\ufffd" in bad:
        text, bad = text[:-1], text[:-1].encode(right).decode(wrong)
    hit, fixed, chains, _ = g.inspect(around.format(bad), model, {})
    assert hit and fixed == around.format(text), (chains, fixed)


@pytest.mark.parametrize("text, whole", [('The button is labelled "CafÃ©" in the menu.', 'The button is labelled "Café" in the menu.'), ("name = 'Ã©tÃ©'", "name = 'été'")])
def test_garbled_names_in_quotes_are_cases(model, text, whole):
    assert g.inspect(text, model, {})[:2] == (True, whole)


def test_example_ends_with_its_sentence(model):
    text = "The codec is wrong where it says 'Ã©'.  The label is 'Ã©tÃ©' here."
    assert g.inspect(text, model, {})[:2] == (True, text.replace("Ã©tÃ©", "été"))
    assert not g.inspect(text.split("  ")[0], model, {})[0]


SOUND = [
    "Öffnen", "À faire", "Да", "°C", "…", "½", "© 2024", "§ 3", "Её", "Señor", "Spaß“", "É !", "№ 5", "µs", "Łódź", "日本", "한국어 문서",
    "Zażółć gęślą jaźń", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Η γλώσσα είναι εύκολη", "Árvíztűrő tükörfúrógép", "Œuvre", "Işık", "Đà Nẵng",
]


@pytest.mark.parametrize("text", SOUND)
def test_short_lines_and_strange_letters_stay(model, text):
    assert g.inspect(text, model, {}) == (False, text, [], False)


def test_of_held_out_sound_lines_at_most_one_in_a_thousand_changes(model):
    rnd, words = random.Random(5), sorted({w for line in LINES for w in line.split()})
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    lines = [x for x in lines if not x.isascii()]
    assert sum(g.inspect(x, model, {})[0] for x in lines) <= len(lines) / 1000


def test_garbled_four_times(model):
    text = bad = LINES[1].format(n=3)
    for _ in range(4):
        bad = decode(bad, "utf-8", "cp1252")
    assert g.inspect(bad, model, {})[1] == text


def test_letters_no_record_has_come_back_where_all_are_utf8(model):
    text = "Zażółć gęślą jaźń i łódź na końcu świata, więc proszę bardzo"
    assert g.inspect(decode(text, "utf-8", "cp1252"), model, {})[1] == text


def test_short_line_is_restored_by_what_its_document_shows(model):
    text = LINES[0].format(n=1) + "\nné"
    assert g.inspect(decode(text, "utf-8", "cp1252"), model, {})[1] == text


@pytest.mark.parametrize("right", ["utf-16-le", "utf-16-be"])
def test_two_byte_characters_read_byte_by_byte(model, right):
    assert g.inspect("note: " + "Mỗi nút"[2:].encode(right).decode("latin-1") + LINES[0].format(n=2).encode(right).decode("latin-1"), model, {})[0]
    text = "La méthode relit le fichier."
    assert g.inspect(text.encode(right).decode("latin-1"), model, {})[1] == text


def test_utf8_read_as_two_byte_characters(model):
    text = "La méthode relit le fichier avant que la classe ne soit créée"
    text += "." * (len(text.encode()) % 2)
    hit, fixed, chains, _ = g.inspect(text.encode().decode("utf-16-le"), model, {})
    assert hit and fixed == text and chains == ["utf-8>utf-16-le"]


def test_margins_come_from_decoys():
    assert g.learned_margins({(-1, 0): 1000})[0] < g.learned_margins({(-1, 0): 1000, (0, 30): 5})[0] == 15.0
