import pytest

from loomgraph.llm.answer_defects import answer_defects, defect_rates, is_truncated

EN = "Why must CachedParser call fetch_query ahead of reserve_watcher whenever the edge is stale?"
ES = "¿Por qué CachedParser debe llamar a fetch_query antes que a reserve_watcher cuando el edge sigue siendo stale?"
FENCE = "```python\nwarm_filter(token)\n```"
CASES = [
    (EN, None, "empty"), (EN, "", "empty"), (EN, " \u00a0\u200b\n", "empty"), (EN, "N/A", "empty"), (EN, "```\n```", "empty"), (None, "...", "empty"), (EN, "null", "empty"),
    (EN, EN, "copy"), (EN, EN.upper(), "copy"), (EN, f"Question: {EN}\nAnswer:", "copy"), (EN, f"**{EN}**", "copy"), (EN, EN.replace(" ", "  ").rstrip("?"), "copy"),
    (EN, "I'm sorry, but I can’t help with that request.", "refusal"), (ES, "Lo siento, no puedo responder a esa pregunta.", "refusal"),
    (EN, "Désolé, je ne peux pas répondre à cette question.", "refusal"), (EN, "Tôi không có đủ thông tin để trả lời về `x`.", "refusal"), (EN, "I CANNOT ANSWER THIS.", "refusal"),
    (EN, "I don't know, the files do not say", "refusal"),
    (EN, "La clase `A` llama primero a `b` y después pasa el valor a `c`.", "language"), (ES, "The class keeps one anchor per handler and drops the rest after each run.", "language"),
    (EN, "`A.b` inherits from `C` and overrides only `d`, which then", "truncated"), (EN, "It is created in `config.", "truncated"), (EN, "Use this:\n\n```python\nvalue = f(x,", "truncated"),
    (EN, "The steps are:\n1. `a`\n2. `b`\n3.", "truncated"), (EN, "It returns the value that `Xy`", "truncated"),
    (EN, "No, only `fold_channel` does.", None), (EN, "`A.b`", None), (EN, f"Sorry if the naming is confusing here: `a` is the public entry point and `b` the internal one.\n\n{FENCE}", None),
    (EN, "You cannot reach `x` without going through `y`, since the unit is private to the class.\n- `A.b`\n- `C.d`", None), (EN, "It only reads the value.\n\nsrc/core/group.py:67-118", None),
    (EN, 'It is kept as it was. ("Return the entries below the index.")', None), (ES, "Si no encuentra nada, `a` lanza un error que `b` registra como aviso. `c`", None),
    (None, "The class keeps one anchor per handler.", None), (ES, FENCE, None),
]


def test_each_case(spark):
    rows = [(i, q, a, "clash") for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:5], "record_id long, question string, answer string, defect string")
    got = answer_defects(df).collect()
    assert len(got) == len({r.record_id for r in got})
    found = {r.record_id: r.defect for r in got}
    assert {i: found.get(i) for i in range(len(CASES))} == {i: d for i, (_, _, d) in enumerate(CASES)}


def test_very_long_answer(spark):
    df = spark.createDataFrame([(1, EN, "The class keeps it. " * 20_000), (2, EN, "and so " * 20_000)], "record_id long, question string, answer string")
    assert {(r.record_id, r.defect) for r in answer_defects(df).collect()} == {(2, "truncated")}


@pytest.mark.parametrize("operator", [answer_defects, defect_rates])
def test_empty_table(spark, operator):
    df = spark.createDataFrame([], "record_id long, mode string, question string, answer string")
    assert operator(df).count() == 0


JA = "なぜ CachedParser は reserve_watcher より先に fetch_query を呼ぶのですか？"
POLISH = "Klasa przechowuje jeden obiekt dla każdego wywołania oraz zwalnia pozostałe zasoby dopiero po zakończeniu całej operacji."


@pytest.mark.parametrize("q, a, defect", [
    (EN, "该类先读取缓存，然后更新索引并返回结果。", "language"), (JA, "该类先读取缓存，然后更新索引并返回结果。", "language"), (EN, POLISH, "language"), (POLISH, "该类先读取缓存，然后更新索引并返回结果。", "language"),
    (JA, "最大値。", None), (JA, "はい、先に索引を読み込みます。", None), ("为什么解析器先读取缓存？", "该类先读取缓存，然后返回结果。", None), ("为什么解析器先读取缓存？", "The class keeps one anchor and drops the rest.", "language"),
])
def test_languages_without_word_list(spark, q, a, defect):
    df = spark.createDataFrame([(1, q, a)], "record_id long, question string, answer string")
    assert [r.defect for r in answer_defects(df).collect()] == ([defect] if defect else [])


GERMAN = "Wie hält die Klasse ihren Zustand, wenn zwei Aufrufe zugleich kommen?"


@pytest.mark.parametrize("q, a, defect", [
    (EN, "De klasse bewaart één object per aanroep en geeft de andere pas na afloop vrij.", "language"), (EN, "La classe conserva un solo oggetto per ogni chiamata e libera gli altri alla fine.", "language"),
    (GERMAN, "De klasse bewaart één object per aanroep en geeft de andere pas na afloop van de hele bewerking vrij.", "language"), (EN, POLISH, "language"),
    (GERMAN, "Sie hält ihn in einem Feld, das nur der Prüfer liest.", None), (EN, "这个类为每个处理程序保留一个锚点。", "language"), ("Почему парсер сначала читает кеш?", "The class keeps one anchor.", "language"),
    (EN, "Mi dispiace, non posso rispondere a questa domanda.", "refusal"), (EN, "抱歉，我无法回答这个问题。", "refusal"), (EN, "Przepraszam, nie mogę odpowiedzieć na to pytanie.", "refusal"), (EN, "I'd rather not discuss that.", "refusal"),
    (EN, "It calls f (which pops the entry.", "truncated"), (EN, 'It sends an open {"a": [1, 2,', "truncated"), (EN, 'It answers "not before the edge.', "truncated"), (EN, "It keeps 3\" of slack (for now).", None),
    (EN, "He said: “it stays «as is» (see [1]).”", None), (GERMAN, "Sie nennt es „Zustand“ und »Feld« (beides).", None), (EN, "Use the interval [0, 10) here.", None), (EN, "It works :( but slowly.", None),
    (EN, f"{EN} {EN} {EN}", "copy"), (EN, "```json\n{\"a\": [1, 2]}\n```", None), (EN, "It opens `f(` and closes it later.", None),
])
def test_further_pairs(spark, q, a, defect):
    df = spark.createDataFrame([(1, q, a, None)], "record_id long, question string, answer string, completion_tokens int")
    assert [r.defect for r in answer_defects(df).collect()] == ([defect] if defect else [])


def test_tokens_at_a_limit_doubt_a_bare_ending():
    long = "It keeps one anchor per handler and drops the rest after each run. " * 16 + "\nhandler"
    assert not is_truncated(long, None) and not is_truncated(long, 300.0) and is_truncated(long, 256.0) and not is_truncated("handler", 256.0)
