"""Broken prompt and response pairs (problem 6): ordered rules in one pass over the records, without a shuffle but the last.

Every rule that triggers is emitted; the first in ``ORDER`` is the pair's defect. Languages are told by script, by the function
words of each language and by letters that only few languages have. The rules run on Arrow batches inside the scan's stage,
since most are searches in short texts that Python does in a fraction of what chained column expressions take; questions that
come again are judged once per task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.spreading import spread

#: Rules in their order; the first that triggers names the defect.
ORDER = ["empty", "copy", "refusal", "language", "truncated"]

#: Ways to write "no value", without marks and in lower case.
STAND_INS = [
    "none", "null", "nil", "na", "nan", "undefined", "void", "empty", "missing", "tbd", "todo", "notavailable",
    "notapplicable", "noanswer", "noresponse", "noneprovided", "emptystring", "unknown", "nodata", "novalue",
]

#: Refusals by language, on lower-case text with straight apostrophes. Each needs the speaker, so that "the caller cannot
#: change x" or "sorry if the naming is confusing" is none.
REFUSALS = {
    "en": r"\bi(?:'m| am| must| have to| will have to|'d have to)? (?:cannot|can't|can not|could not|couldn't|unable|not able|not allowed|"
    r"not permitted|won't|will not|refuse|decline|don't know|do not know|don't have|do not have|lack)\b|\bi (?:must|have to) (?:decline|refuse)\b|"
    r"\bas an? (?:ai|language|large language)\b.{0,40}\b(?:model|assistant)\b|\b(?:isn't|is not|not) (?:enough|sufficient) (?:information|context)\b|"
    r"\boutside (?:of )?what i\b|\bi won't be able\b|\bunable to (?:answer|help|assist|comment)\b|\bno idea\b|\bi(?:'d| would)? (?:rather|prefer)(?: to)? not\b",
    "es": r"\bno (?:puedo|podemos|podré|podría|sé|tengo|dispongo)\b|\bno me es posible\b|\blo siento\b|\bdesconozco\b|\bsoy un modelo\b|\bcomo modelo de\b|\bno estoy (?:autorizado|en condiciones)\b",
    "fr": r"\bje ne (?:peux|puis|sais|suis pas en mesure|dispose|saurais)\b|\bil m'est impossible\b|\bje n'ai (?:pas|aucun)\b|\bdésolée?\b.{0,40}\b(?:ne|impossible)\b|\ben tant que modèle\b|\bje (?:dois|préfère) (?:refuser|décliner)\b|\bje refuse\b",
    "de": r"\b(?:kann|darf|möchte|könnte|weiß) ich\b.{0,60}\bnicht\b|\bich (?:kann|darf|möchte|weiß|könnte)\b.{0,80}\b(?:nicht|keine?n?)\b|\bmir (?:fehlen|fehlt)\b|\bals sprachmodell\b|\bich habe (?:nicht genug|keinen|keine)\b|\bkann ich nichts sagen\b|\bdarf ich leider\b",
    "vi": r"tôi (?:không|chưa) (?:thể|có|biết|được phép|rõ)|xin lỗi|rất tiếc|là (?:một )?mô hình ngôn ngữ",
    "pt": r"\bnão (?:posso|consigo|tenho|sei|disponho)\b|\bdesculpe\b|\bcomo modelo de\b|\binfelizmente não\b",
    "ru": r"\bя не (?:могу|знаю|имею|располагаю)\b|\bне могу (?:ответить|помочь)\b|\bизвините\b|\bк сожалению\b",
    "ja": r"申し訳|お答えできません|回答できません|お手伝いできません|わかりません|分かりません",
    "it": r"\bnon (?:posso|so|sono in grado|sono autorizzat[oa]|dispongo|ho (?:abbastanza|informazioni))\b|\bmi è impossibile\b|\bcome modello linguistico\b|\bpreferisco non\b",
    "pl": r"\bnie (?:mogę|potrafię|wiem|mam (?:dostępu|wystarczając\w*|informacji)|jestem w stanie)\b|\bjako model językowy\b|\bodmawiam\b",
    "nl": r"\bik (?:kan|mag|weet|wil)\b.{0,60}\b(?:niet|geen)\b|\bals taalmodel\b|\bik heb (?:niet genoeg|geen)\b",
    "zh": r"我(?:无法|不能|不知道|没有足够|不便)|无法(?:回答|提供|协助)|作为(?:一个)?(?:人工智能|语言模型)|抱歉，",
    "ko": r"(?:답변|도움|제공).{0,10}(?:수 없|드릴 수 없)|모르겠습니다|언어 모델로서",
}
#: Sentences that may stand beside a refusal without making it an answer.
ASIDES = r"^\W*(?:(?:i'm |i am )?(?:so |very |truly )?(?:sorry|afraid)|apologies|my apologies|unfortunately|désolée?|lo siento|lamentablemente|tut mir leid|es tut mir leid|leider|xin lỗi|rất tiếc|mi dispiace|spiacente|desculpe|przepraszam|przykro mi|het spijt me|sorry|извините|к сожалению|抱歉|对不起|申し訳ありません(?:が)?|please (?:consult|contact|ask|try|provide|check|refer|see).*|thank you.*)\W*$"

#: Function words by language. A word that several languages have counts for each in part.
WORDS = {
    "en": "the is are was were be been and or of to in on at by for from with without into before after under over than then that this these those which who what when where why how it its they their there not no yes only also any all each both if while until because as so but must can cannot should would will does do did has have had an a i you we",
    "vi": "là và của được trong không thì cho như thế nào vì sao khi các bởi phải nếu đã sẽ với một này những trước sau rồi mới tại từ để có cũng chỉ đó ra vào đến hay hoặc mà do nên lại vẫn còn theo bằng",
    "fr": "le la les l des du de un une et ou où est sont était dans que qui quoi pour par avec sans sur sous afin avant après donc comme comment pourquoi lorsque quand pas ne n se s ce cet cette ces son sa ses leur leurs il elle ils elles on au aux en y à mais si rien puis aussi tout tous être avoir a ont doit peut fait d qu jusqu",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden wurde nicht nur auch von vom zu zum zur mit ohne im in auf an am aus bei für über unter vor nach durch wenn weil damit dass daher dann so wie warum wer was wo sich es er sie wir ich kein keine diese dieser dieses als noch schon bleibt bleiben kann muss soll darf hat haben",
    "es": "el la los las lo un una unos unas y o es son era fue que qué quien cual cuál cómo como cuando cuándo donde por para de del en con sin sobre entre antes después desde hasta no ni si sí se su sus al más pero así nada cada este esta estos estas ese esa esto eso sólo solo también ya le les ha han debe puede sigue porque",
    "pt": "o a os as um uma uns umas e ou é são era foi que quem qual como quando onde por para de do da dos das no na nos nas em com sem sobre entre antes depois desde até não nem se seu sua seus suas ao à mais mas assim nada cada este esta esse essa isso isto só também já lhe há deve pode porque pelo pela",
    "it": "il lo la i gli le un uno una e o è sono era che chi cosa come quando dove perché per di del della dei delle dello nel nella nei nelle in con senza su sul sulla tra fra prima dopo non né se si suo sua suoi sue al alla ai alle più ma così nulla ogni questo questa questi quello quella solo anche già ha hanno deve può da dal dalla viene",
    "nl": "de het een en of is zijn was worden wordt werd niet geen ook alleen van voor met zonder in op aan uit bij over onder na door als omdat zodat dat die dit deze dan hoe waarom wie wat waar zich hij zij wij ik er nog al naar tot om te kan moet mag heeft hebben maar dus",
    "pl": "i oraz lub albo jest są był była było być nie tak tylko też także od do z ze w we na po przed za dla bez przez pod nad między gdy kiedy jeśli jeżeli ponieważ że który która które co kto jak gdzie dlaczego się jego jej ich ten ta to tego tej te już jeszcze ale więc każdy każda może musi ma mają zostaje dopiero",
}
#: Letters that tell a language by themselves, by word.
LETTERS = {
    "vi": "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "de": "ß", "es": "ñ", "pt": "ãõ", "pl": "łżźćńśąę", "fr": "œ",
}
#: Scripts that one language has among those served here; Han without kana is Chinese.
SCRIPTS = {"CYRILLIC": "ru", "KANA": "ja", "HANGUL": "ko", "GREEK": "el", "THAI": "th", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi"}
#: Different words that prose must have before it counts that none of them is one of the question's language.
LONG = 12
#: Han letters without kana from which an answer is no longer Japanese; letters of another script that are a mismatch.
LONG_HAN, LONG_SCRIPT = 12, 3
#: Numbers of tokens at which generation is commonly cut off.
LIMITS = {128, 256, 512, 1024, 2048, 4096, 8192}

_fence = re.compile(r"```.*?```", re.S)
_ticks = re.compile(r"`[^`]*(?:`|$)")
_quoted = re.compile("\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]")
_token = re.compile(r"[\w\u0300-\u036f./]+")
_camel = re.compile("[a-z][A-Z]")
_run = re.compile(r"[^\W\d]+(?:[\u0300-\u036f]+[^\W\d]*)*")
_curly = re.compile("[’ʼ]")
_mark = re.compile(r"[()\[\]{}\"“”„«»]")
_no_letters = re.compile(r"[\W_]+")
_no_code = re.compile(r"```\w*\s*```")
_frame = re.compile("^(?:question|frage|pregunta|câuhỏi|domanda|pergunta|вопрос|q)(?=.{20})|(?<=.{20})(?:answer|réponse|antwort|respuesta|trảlời|risposta|resposta|ответ|a)$")
_split = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_refusal = re.compile("|".join(REFUSALS.values()))
_aside = re.compile(ASIDES)


def prose_words(text: str) -> set[str]:
    """The different words of ``text``, in lower case, without code, quoted passages and identifiers."""
    if "`" in text:
        text = _ticks.sub(" ", _fence.sub(" ", text))
    if _mark.search(text):
        text = _quoted.sub(" ", text)
    out = set()
    for token in _token.findall(text):
        token = token.strip("./")
        if "_" in token or "." in token or "/" in token:
            continue
        low = token.lower()
        if low != token and token[1:] != low[1:] and _camel.search(token):
            continue
        if low.isalpha():
            out.add(low)
        else:
            out.update(_run.findall(low))
    return out


@lru_cache(maxsize=100_000)
def _script(char: str) -> str:
    """The script of a letter; Hiragana and Katakana are one."""
    name = unicodedata.name(char, "?").split(" ")[0]
    return "KANA" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA") else "HAN" if name == "CJK" else name


def _weights() -> dict[str, tuple[tuple[str, float], ...]]:
    held = {k: set(v.split()) for k, v in WORDS.items()}
    words = {w for v in held.values() for w in v}
    of = {w: [k for k, v in held.items() if w in v] for w in words}
    return {w: tuple((k, 1 / len(ks)) for k in ks) for w, ks in of.items()}


_WEIGHTS = _weights()
_TELLING = {c: k for k, v in LETTERS.items() for c in v}


class Language:
    """What speaks for each language in the prose of a text: hits (language to weight), different words, letters by script."""

    def __init__(self, text: str):
        words = prose_words(text)
        self.words = len(words)
        hits: dict[str, float] = {}
        scripts: Counter = Counter()
        for w in words:
            for k, weight in _WEIGHTS.get(w, ()):
                hits[k] = hits.get(k, 0.0) + weight
            if w.isascii():
                scripts["LATIN"] += len(w)
                continue
            telling = {_TELLING[c] for c in w if c in _TELLING}
            for k in telling:
                hits[k] = hits.get(k, 0.0) + 1.0
            own = Counter(_script(c) for c in w if c.isalpha())
            scripts.update(own)
            for s in own:
                if s in SCRIPTS:
                    hits[SCRIPTS[s]] = hits.get(SCRIPTS[s], 0.0) + 1.0
        if scripts["HAN"] and not scripts["KANA"]:
            hits["zh"] = scripts["HAN"] / 2
        self.hits, self.scripts = hits, scripts
        ranked = sorted(hits.items(), key=lambda x: (-x[1], x[0]))
        #: The language; None where two tie or nothing speaks.
        self.name = ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] > ranked[1][1] + 1e-9) else None
        self.most = ranked[0][1] if ranked else 0.0


def is_other_language(q: Language, a: Language) -> bool:
    """The answer's prose is in another language than the question's.

    Where most of its letters are of scripts that the question has not, it is. Where the answer's language is not clear, it is
    another one if languages tie of which none is the question's, or if long prose has no word of the question's language.
    """
    own = {s for s, n in q.scripts.items() if n}
    if "KANA" in own:
        own.add("HAN")
    foreign = sum(n for s, n in a.scripts.items() if s not in own)
    han = q.name == "ja" and a.name == "zh" and a.scripts["HAN"] < LONG_HAN
    if own and q.words >= 2 and foreign >= LONG_SCRIPT and foreign * 2 > sum(a.scripts.values()) and not han:
        return True
    if q.name is None:
        return False
    if a.name is None:
        return q.hits and not a.hits.get(q.name) and (a.most >= 2 or a.words >= LONG)
    return a.name != q.name and not han and a.hits[a.name] >= a.hits.get(q.name, 0.0) + 0.5


def letters(text: str | None) -> str:
    return _no_letters.sub("", text.upper().lower()) if text else ""


def is_empty(answer: str | None) -> bool:
    """Null, only blanks, invisible characters or marks, or a stand-in for no value. A code block with no code is a mark."""
    left = letters(_no_code.sub("", answer)) if answer else ""
    return left == "" or left in STAND_INS


def is_copy(q: str, a: str) -> bool:
    """Only the question again, once or more: layout, case, marks and a "Question: ... Answer:" frame aside, whole or most of its
    start. Takes the letters and digits of question and answer."""
    if not q:
        return False
    bare = _frame.sub("", a)
    again = len(a) % len(q) == 0 and a == q * (len(a) // len(q))
    return again or bare == q or q.startswith(a) and len(a) >= 20 and len(a) * 10 >= len(q) * 6


@lru_cache(maxsize=100_000)
def _kind(sentence: str) -> str:
    """'refusal', 'aside', or '' for a sentence that says more."""
    return "refusal" if _refusal.search(sentence) else "aside" if _aside.match(sentence) else ""


def is_refusal(answer: str) -> bool:
    """Every sentence refuses (in any of the languages) or merely apologises, and at least one refuses."""
    text = re.sub("`[^`]*`", "x", _curly.sub("'", answer.strip()).lower())
    refuses = False
    for sentence in _split.split(text):
        if sentence and any(c.isalnum() for c in sentence):
            kind = _kind(sentence)
            if not kind:
                return False
            refuses = refuses or kind == "refusal"
    return refuses


_end = re.compile(r"[.!?…。！？][\"'»”’)\]*_]*$")
_number = re.compile(r"^\s*\d+[.)]$")
_file = re.compile(r"^\s*(?:[-*•]\s+|\d+[.)]\s+)?[\w.\-/]*\w\.[A-Za-z]{1,5}(?::\d+(?:-\d+)?)?$")
_tick_item = re.compile(r"^\s*(?:(?:[-*•]|\d+[.)])\s+)?`[^`]+`$")
_tick_after = re.compile(r"[.!?…:。！？][\"'»”’)\]]*\s+`[^`]+`$")
_bare = re.compile(r"^\s*(?:(?:[-*•]|\d+[.)])\s+)?[A-Za-z_][\w.]*(?:\(\))?$")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "»": "«"}


def _unclosed(text: str) -> bool:
    """Whether a bracket, a quotation mark, a back-tick or a code fence that opens in ``text`` stays open.

    Code stands for itself. Marks that close nothing are ignored, and so are straight quotes after a digit (inches) and brackets
    after a colon (faces). Any bracket closes the last one of its kind and what was opened within it.
    """
    if text.count("```") % 2:
        return True
    outside = _fence.sub("", text)
    if outside.count("`") % 2:
        return True
    outside = _ticks.sub("", outside)
    stack: list[str] = []
    for m in _mark.finditer(outside):
        c, before = m[0], outside[m.start() - 1 : m.start()]
        if c == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            elif not before.isdigit():
                stack.append(c)
        elif c in "([{„«" or c == "“" and "„" not in stack:
            if before not in (":", ";"):
                stack.append(c)
        elif c == "»" and "«" not in stack:
            stack.append(c)  # »so« in German
        else:
            opener = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in _CLOSES[c] or c in ")]" and stack[i] in "(["), None)
            if opener is not None:
                del stack[opener:]
        if c == "«" and len(stack) > 1 and stack[-2] == "»":
            del stack[-2:]
    return bool(stack)


def is_truncated(answer: str, tokens: float | None) -> bool:
    """Breaks off before its sentence, list or code block is complete. A single bare name counts as complete unless the number of
    completion tokens is one at which generation is commonly cut off and the answer may have as many."""
    t = answer.rstrip()
    while t and unicodedata.category(t[-1])[0] in "ZC":
        t = t[:-1].rstrip()
    if _unclosed(t):
        return True
    last = t[t.rfind("\n") + 1 :]
    if t.endswith("```") or _end.search(t) and not _number.match(last) or _file.match(last) or _tick_item.match(last) or _tick_after.search(t):
        return False
    cut = tokens in LIMITS and len(t) >= 2 * tokens
    return cut or not _bare.match(last)


def judge(question: str | None, answer: str | None, tokens: float | None, language: Language | None) -> list[str]:
    """The defects of a pair in their order; ``language`` is the question's."""
    if is_empty(answer):
        return ["empty"]
    found = []
    if is_copy(letters(question), letters(answer)):
        found.append("copy")
    if is_refusal(answer):
        found.append("refusal")
    if language is not None and is_other_language(language, Language(answer)):
        found.append("language")
    if is_truncated(answer, tokens):
        found.append("truncated")
    return found


def answer_defects(
    records: DataFrame, key: str = "record_id", question: str = "question", answer: str = "answer", tokens: str = "completion_tokens"
) -> DataFrame:
    """Defective pairs: key, defect (the first that triggered), defects (all that triggered, in order).

    A null or empty answer is 'empty', whatever the question; a null question triggers neither 'copy' nor 'language'. ``tokens``
    may be missing or null. Repeated rows give one row; null keys are kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    kind = dict(records.dtypes)[key]
    n_tokens = F.col(tokens).cast("double") if tokens in records.columns else F.lit(None).cast("double")
    pairs = spread(records.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"), n_tokens.alias("n")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages: dict[str, Language] = {}
        for batch in batches:
            rows = []
            for k, q, a, n in zip(batch["k"], batch["q"], batch["a"], batch["n"], strict=True):
                if q is not None and q not in languages:
                    if len(languages) > 50_000:
                        languages.clear()
                    languages[q] = Language(q)
                found = judge(q, a, n, languages.get(q))
                if found:
                    rows.append((k, found[0], found))
            yield pd.DataFrame(rows, columns=[key, "defect", "defects"]).astype({key: batch["k"].dtype})

    return pairs.mapInPandas(run, f"`{key}` {kind}, defect string, defects array<string>").distinct()


def defect_rates(records: DataFrame) -> DataFrame:
    """Records and defective records per mode: mode, defect ('' counts all records), n. Repeated rows count once."""
    modes = records.select(F.col("record_id").alias("id"), "mode").dropDuplicates(["id"])
    bad = answer_defects(records)
    hit = modes.join(bad, modes["id"] == bad["record_id"]).groupBy("mode", "defect").agg(F.count("*").alias("n"))
    return hit.unionByName(modes.groupBy("mode").agg(F.count("*").alias("n")).withColumn("defect", F.lit("")))
