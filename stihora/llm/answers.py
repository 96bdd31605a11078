"""Broken prompt and response pairs (problem 4).

Ordered rules over each answer, once reasoning, markup, introductions and
closing remarks are taken off: no prompt, nothing left, a refusal, the prompt
copied, another language or none known, an unclosed delimiter or an abrupt
end.  Every rule that applies is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, longest_common, word_hashes
from .language import Model, languages_of
from .normal_form import repair_characters

#: The defects in their order; the first that applies is an example's defect.
DEFECTS = ("no_prompt", "empty", "refusal", "copy", "wrong_language", "truncated")
#: Share of an answer's words that must be the prompt's, in the same order, for a copy.
COPIED = 0.8

_REASONING = regex.compile(r"(?is)<(think|thinking|reasoning|reflection|analysis|scratchpad)\b[^>]*>.*?(?:</\1\s*>|$)|\[(think|thinking|reasoning)\].*?(?:\[/\2\]|$)|<\|channel\|?>\s*(?:analysis|thought).*?(?:<\|?channel\|>|<\|message\|>|$)")
_TAGS = regex.compile(r"<\|[^|<>\n]{0,40}\|>|</?[\p{L}!][^<>\n]{0,60}>|\[/?INST\]|<<?/?SYS>?>")
_FENCE = regex.compile(r"^\s*(?:`{3,}|~{3,}|\"{3,}|'{3,})[\w+-]*\s*$")
_RULE = regex.compile(r"^[\s\p{P}\p{S}\p{Z}\p{C}]*$")
_HEADING = regex.compile(r"^\s*(?:#{1,6}\s+\S.*|(?:\*\*|__)[^*_\n]{1,120}(?:\*\*|__)\s*|(?:наслов|title|naslov)\s*[:：].*)$", regex.I)
_INTRODUCTION = regex.compile(r"^[^\n]{2,120}[:：]\s*$")
_ROLE = regex.compile(r"^\s*(?:assistant|асистент|answer|одговор|response|bot|model)\s*[:：]\s*", regex.I)
_REMARK = regex.compile(r"^\s*[*_~`\"'„“«»]*\s*(?:\([^()\n]*\)|\[[^\[\]\n]*\]|\{[^{}\n]*\})\s*[*_~`\"'„“«»]*[.!]?\s*$")
_LAST_LINE = regex.compile(r"^\s*[-–—*_=~#\s]*(?:крај|крајот|kraj|the end|end|fin|finis|ende|fund|son|конец|край)[-–—*_=~#.!\s]*$", regex.I)
_PLACEHOLDER = regex.compile(r"^(?:n/?a|none|null|nil|todo|tbd|nan|undefined|empty|placeholder|lorem ipsum|нема|празно|недостасува|(?:no |the )?(?:poem|text|answer|response|output)(?: here)?|(?:овде |тука )?(?:песна|текст|стих)(?:та|от)?(?: овде| тука)?)$", regex.I)

#: How a model says that it declines, by language: words of inability or refusal, and words of writing.
_UNABLE = {
    "mk": (r"не можам|не сум во можност|немам можност|не би|не смеам|нема да|одбивам|морам да одбијам|не ми е дозволено|не сум во состојба|не е можно|мора(?:м)? да (?:го |ја |ве )?одбијам|не сакам", r"пиш|состав|создад|создав|создал|творам|сторам|преведам|пренес|преработ|прераск|верзија|исполн|помогн|направ|генерир|препе|обезбед|изготв|понуд|дадам|продолж|барање|одговор|стихови|песна"),
    "sr": (r"не могу|нисам у могућности|не бих|не смем|одбијам|морам да одбијем|нећу|ne mogu|nisam u mogućnosti|ne bih|ne smem|odbijam|moram da odbijem|neću", r"пиш|пис|састав|створ|урад|испун|помог|направ|генери|пруж|захтев|песм|стих|верзиј|piš|pis|verzij|sastav|stvor|urad|ispun|pomog|naprav|generi|pruž|zahtev|pesm|stih"),
    "bg": (r"не мога|не съм в състояние|нямам възможност|не бих|отказвам|няма да|не ми е позволено", r"пиш|състав|съчин|създ|верси|направ|изпълн|помог|генерир|предостав|искане|стих|песен"),
    "ru": (r"не могу|не в состоянии|не имею возможности|не буду|отказываюсь|не стану|не смогу|вынужден\p{L}* отказать", r"пис|пиш|сочин|верси|созда|сделать|выполн|помочь|сгенерир|предостав|просьб|запрос|стих|песн"),
    "en": (r"cannot|can['’]?t|can not|unable|won['’]?t|will not|am not able|not able|must decline|have to decline|decline|refuse|couldn['’]?t|not comfortable|not permitted|not allowed", r"writ|compos|creat|produc|provid|generat|help|assist|fulfil|comply|do that|do this|request|poem|vers|continue|translate|rewrite"),
    "sq": (r"nuk mund|s['’]mund|nuk jam në gjendje|nuk do të|refuzoj|më duhet të refuzoj", r"shkru|shkruaj|krijo|version|kompoz|ndihmo|përmbush|bëj|ofro|kërkes|poezi|varg"),
    "tr": (r"yapamam|yazamam|edemem|oluşturamam|sunamam|veremem|yardımcı olamam|mümkün değil|reddediyorum|reddetmek zorundayım|üzgünüm", r"yaz|oluştur|sürüm|üret|yardım|yap|iste|şiir|dize|sun"),
    "de": (r"kann (?:ich )?(?:\p{L}+ ){0,4}nicht|kann (?:ich )?(?:\p{L}+ ){0,2}kein\p{L}*|nicht in der lage|darf (?:ich )?(?:\p{L}+ ){0,3}nicht|werde (?:ich )?(?:\p{L}+ ){0,3}(?:nicht|kein)|lehne|muss (?:\p{L}+ ){0,3}ablehnen|nicht möglich", r"schreib|verfass|version|erstell|dicht|liefer|helf|erfüll|generier|bereitstell|anfrage|bitte|gedicht|vers|ablehn"),
}
#: How a refusal begins or what it says of itself; with these the words above may stand further apart.
_EXCUSE = r"language model|as an ai|i['’]?m sorry|i am sorry|i apologi|sorry|unfortunately|јазичен модел|вештачка интелигенција|се извинувам|извинете|извини|жал ми е|за жал|нажалост|језички модел|жао ми је|нажалост|jezički model|žao mi je|nažalost|езиков модел|съжалявам|за съжаление|языковая модель|извините|к сожалению|простите|model gjuhësor|më vjen keq|fatkeqësisht|dil modeli|üzgünüm|maalesef|ne yazık ki|sprachmodell|tut mir leid|leider|entschuldig"
_REFUSALS = [regex.compile(rf"\b(?:{a})(?:\s+[\p{{L}}']+){{0,4}}?\s+(?:\p{{L}}*?)(?:{b})|\b(?:{b})\p{{L}}*(?:\s+[\p{{L}}']+){{0,4}}?\s+(?:{a})\b") for a, b in _UNABLE.values()]
_APOLOGIES = [regex.compile(rf"(?:{_EXCUSE}).{{0,80}}?\b(?:{a})\b") for a, _ in _UNABLE.values()]
_EXCUSED = regex.compile(_EXCUSE)
#: Words of declining, which need no word of writing beside what is quoted.
_DECLINED = regex.compile(r"\b(?:одбивам|одбијам|odbijam|отказвам|откажа|отказываюсь|отказаться|отказать|decline|refuse|refuzoj|reddediyorum|reddetmek|ablehnen|lehne)\b")
#: Whose rules a refusal appeals to; these need nothing beside them.
_RULES = regex.compile(r"against (?:my|our) (?:guidelines|rules|polic\p{L}+|instructions)|(?:спротивно на|против) (?:моите|нашите) (?:правила|насоки|упатства)|(?:противно|против) (?:мојих?|наших) (?:правила|смерниц\p{L}+|упутст\p{L}+)|против (?:моите|нашите) (?:правила|насоки)|(?:противоречит|против) (?:моим|моих|нашим|наших) (?:правил\p{L}*|принцип\p{L}*|инструкци\p{L}+)|kundër (?:rregullave|udhëzimeve)|kurallarıma aykırı|ilkelerime aykırı|gegen meine (?:richtlinien|regeln|vorgaben)")
_UNABLE_AT_ALL = regex.compile("|".join(a for a, _ in _UNABLE.values()))
_QUOTED = regex.compile(r"„[^“”\"\n]*[“”\"]|«[^»\n]*»|“[^”\n]*”|\"[^\"\n]*\"")

_CLOSERS = {"(": ")", "[": "]", "{": "}", "„": "“”\"", "«": "»", "»": "«", "“": "”"}
_DELIMITER = regex.compile(r"[()\[\]{}„“”«»\"]")
#: Marks that may open or close; they open only before a word that they stand apart from what comes before.
_EITHER = regex.compile(r"(?<![^\s\p{P}])[“»\"](?=\w)")

_END = regex.compile(r"[.!?…。！？][\s\p{Z}\p{Cf}\"'“”’»«›)\]*_`~|/]*$")


def body(answer: str | None) -> str:
    """An answer in one form, without reasoning."""
    return _REASONING.sub("", repair_characters(answer or ""))


def poem_text(answer: str | None) -> str:
    """What is left of an answer without reasoning, markup, headings, introduction and closing remarks."""
    return _poem(body(answer))


def _poem(text: str) -> str:
    text = _ROLE.sub("", _TAGS.sub("", text))
    lines = text.splitlines()
    lines = [x for x in lines if not _FENCE.match(x)]
    changed = True
    while changed and lines:
        changed = False
        while lines and _RULE.match(lines[-1]) and (not lines[-1].strip() or regex.search(r"^[\s*_=#~`\"'—–-]*$", lines[-1])):
            lines.pop()
            changed = True
        if lines and (_REMARK.match(lines[-1]) or _LAST_LINE.match(lines[-1])):
            lines.pop()
            changed = True
    while lines and (_RULE.match(lines[0]) or _HEADING.match(lines[0]) or _INTRODUCTION.match(lines[0])) and len(lines) > 1:
        lines.pop(0)
    if len(lines) == 1 and (_RULE.match(lines[0]) or _HEADING.match(lines[0])):
        lines = []
    return "\n".join(lines).strip()


def is_empty(text: str) -> bool:
    """True if a text has no letters or digits, or is a placeholder."""
    words = regex.sub(r"[^\p{L}\p{N}/]+", " ", text).strip()
    return not words or bool(_PLACEHOLDER.match(words))


def _prose(text: str) -> list[str]:
    """The lines that are whole sentences, in lower case, without markup and what they quote."""
    lines = [x for x in text.splitlines() if not _RULE.match(x)]
    # a line of verse runs on into the next one; the last line may have been cut
    whole = [bool(_END.search(x)) or i == len(lines) - 1 for i, x in enumerate(lines)]
    found = [x for i, x in enumerate(lines) if whole[i] and (i == 0 or whole[i - 1] or x.lstrip()[0] in "„-–—")]
    found = [_QUOTED.sub(" „“ ", _TAGS.sub("", x)).lower().replace("’", "'").replace("`", " ") for x in found]
    return [" ".join(x.split()) for x in found]


def is_refusal(answer: str | None) -> bool:
    """True if an answer declines in place of a poem, in any of the eight languages.

    Every sentence of the whole answer is looked at, without what it quotes,
    but only in lines that hold whole sentences: a poem may speak of not being
    able to write, and does so in verses that run on.  A sentence that says
    that the model is unable or unwilling counts if it also excuses itself,
    quotes what it declines, appeals to rules, or is all the answer holds.
    """
    return _refuses(body(answer))


def _refuses(text: str) -> bool:
    prose = _prose(text)
    for line in prose:
        if not (_UNABLE_AT_ALL.search(line) or _RULES.search(line)):
            continue
        before = ""
        for sentence in regex.split(r"(?<=[.!?])\s", line):
            near = f"{before} {sentence}"
            excused = bool(_EXCUSED.search(near)) or "„“" in sentence
            if _RULES.search(sentence) or (excused and _DECLINED.search(sentence)):
                return True
            if any(p.search(sentence) for p in _REFUSALS) and (excused or len(prose) == 1):
                return True
            if _EXCUSED.search(sentence[:40]) and any(p.search(sentence) for p in _APOLOGIES):
                return True
            before = sentence
    return False


def is_unclosed(text: str) -> bool:
    """True if a bracket or quotation mark is opened and never closed, but for one around the whole text.

    A closing mark closes the last one of its kind that is open; without any,
    it is passed over, unless it may open one and stands before a word.
    """
    open_: list[str] = []
    opening = {m.start() for m in _EITHER.finditer(text)}
    for m in _DELIMITER.finditer(text):
        c = m.group()
        at = next((i for i in range(len(open_) - 1, -1, -1) if c in _CLOSERS.get(open_[i], open_[i])), None)
        if at is not None:
            del open_[at:]
        elif m.start() and (c in "([{„«" or m.start() in opening):
            open_.append(c)
    return bool(open_)


def ends_abruptly(text: str) -> bool:
    """True if a text stops inside a word or sentence."""
    return not _END.search(text)


def defects(examples: DataFrame, prompts: DataFrame, model: Model, language: str = "mk", copied: float = COPIED) -> DataFrame:
    """(example_id, defect, place): every defect of each example, place being its rank in DEFECTS.

    `examples` has example_id, source_id and answer, `prompts` has id and
    text; of several texts of one id the last in binary order is taken.  Texts are compared in words, without case, marks, punctuation,
    spacing and look-alike characters.  Null ids of examples are kept as null;
    repeated examples give their defects once.  Examples without a prompt do
    not take part in the join, so a missing id cannot gather in one task; a
    prompt with very many examples is split by the adaptive join.
    """
    rows = examples.select("example_id", "source_id", "answer")
    texts = prompts.select(F.col("id").alias("source_id"), F.col("text").alias("prompt")).filter(F.col("source_id").isNotNull() & F.col("prompt").rlike(r"[^\s\p{Z}\p{Cf}]"))
    texts = texts.groupBy("source_id").agg(F.max("prompt").alias("prompt"))  # a prompt that was delivered again counts once
    joined = rows.filter("source_id is not null").join(texts, "source_id", "left").select("example_id", "answer", "prompt")
    alone = rows.filter("source_id is null").select("example_id", "answer", F.lit(None).cast("string").alias("prompt"))
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, answers, sources = (batch.column(c).to_pylist() for c in ("example_id", "answer", "prompt"))
            for a, b in chunks([(x or "") + (y or "") for x, y in zip(answers, sources, strict=True)]):
                out = []
                bodies = [body(x) for x in answers[a:b]]
                poems = [_poem(x) for x in bodies]
                own, ooff = word_hashes(poems)
                src, soff = word_hashes(sources[a:b])
                spoken = languages_of(poems, model)
                for i, poem in enumerate(poems):
                    found = []
                    if sources[a + i] is None:
                        found.append("no_prompt")
                    if is_empty(poem):
                        found.append("empty")
                    else:
                        words = own[ooff[i] : ooff[i + 1]]
                        if _refuses(bodies[i]):
                            found.append("refusal")
                        if len(words) and longest_common(words, src[soff[i] : soff[i + 1]]) >= copied * len(words):
                            found.append("copy")
                        # the runner-up of a poem in no known language is the one it is nearest to
                        if spoken[i] and (spoken[i][0][1] or spoken[i][0][6]) != language:
                            found.append("wrong_language")
                        # what is opened in the poem may be closed by what was taken off
                        if ends_abruptly(poem) or (is_unclosed(poem) and is_unclosed(bodies[i])):
                            found.append("truncated")
                    out += [(ids[a + i], d, DEFECTS.index(d)) for d in found]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["example_id", "defect", "place"])

    return joined.unionByName(alone).mapInArrow(judge, "example_id string, defect string, place int").distinct()


def first_defects(found: DataFrame) -> DataFrame:
    """(example_id, defect): the first defect of each example."""
    return found.groupBy("example_id").agg(F.min_by("defect", "place").alias("defect"))
