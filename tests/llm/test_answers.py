import os

import pytest

from stihora.llm import answers, language

DATA = "/root/testdata/sf0.001"
POEM = "Ноќе тече река под стариот мост,\nниту ѕвезда гори над тивката гора.\nНекој чека писмо крај прозорецот…\nУтре ќе се врати ластовицата дома."


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_each_defect(spark):
    source = "Таму расте трева зад белата куќа,\nдетето ги брои птиците на патот.\nМајка му ја носи топлата погача."
    cases = {
        "fine": (1, POEM), "fenced": (1, f"```\n{POEM}\n```"), "remark": (1, f"Еве ја песната:\n\n**Мост**\n\n{POEM}\n\n(крај)"), "thought": (1, f"<think>Чекај, мост</think>\n{POEM}"),
        "sleepless": (1, "Не можам да заспијам, реко,\n" + POEM), "none": (None, POEM), "blank_prompt": (2, POEM), "unknown": (99, POEM),
        "null": (1, None), "dots": (1, "..."), "mark": (1, "[ ]"), "only_thought": (1, "<think>Ноќ, река"), "fences": (1, "```\n```"), "invisible": (1, "​​"),
        "declined": (1, "Жал ми е, но не можам да напишам стихови по „Таму расте трева“."), "declined_en": (1, "I'm sorry, but I can't write a poem after „X“."),
        "copied": (1, source.upper().replace(",", " —")), "english": (1, "The old river sleeps under the bridge tonight,\nnobody waits for letters at the window anymore."),
        "cut": (1, POEM[:-20]), "comma": (1, POEM[:-1] + ","), "cut_fence": (1, f"```\n{POEM[:-8]}\n```"), "open_quote": (1, POEM + "\n„Дојди кај мене (во куќата."), "quote": (1, POEM + "\n„Дојди кај мене (во куќата).“"),
        "french": (1, "Les nuages passent lentement au-dessus de la ville endormie\net personne ne regarde le ciel quand la pluie commence à tomber."),
    }
    want = {
        "none": "no_prompt", "blank_prompt": "no_prompt", "unknown": "no_prompt", "null": "empty", "dots": "empty", "mark": "empty", "only_thought": "empty", "fences": "empty",
        "invisible": "empty", "declined": "refusal", "declined_en": "refusal", "copied": "copy", "english": "wrong_language", "cut": "truncated", "comma": "truncated", "cut_fence": "truncated", "open_quote": "truncated", "french": "wrong_language",
    }
    examples = spark.createDataFrame([(k, s, a, "x") for k, (s, a) in cases.items()] + [("null", 1, None, "x")], "example_id string, source_id long, answer string, defect string")
    prompts = spark.createDataFrame([(1, source), (2, " "), (3, None), (None, source)], "id long, text string")
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet").select("lang", "text")
    model = language.fit_on_tables(samples)
    got = {r.example_id: r.defect for r in answers.first_defects(answers.defects(examples, prompts, model)).collect()}
    assert got == want
    assert answers.defects(examples.limit(0), prompts, model).count() == 0


def test_refusals_in_eight_languages():
    said = [
        "Es tut mir leid, aber ich kann kein Gedicht schreiben.", "Üzgünüm, bu şiiri yazamam.", "К сожалению, я не могу написать это стихотворение.", "Съжалявам, но не мога да напиша това.",
        "Žao mi je, ali ne mogu da napišem ovu pesmu.", "Жао ми је, али не могу да напишем ову песму.", "Më vjen keq, por nuk mund ta shkruaj këtë poezi.", "Ова не можам да го сторам: „X“.", "I must decline to rewrite „X“.",
    ]
    said += [
        "Thank you for this lovely request. I have read the whole poem with care. It is about a river. Unfortunately I cannot write verses like these.",
        "I must respectfully pass on this one, it is against my guidelines.",
        "Прекрасна песна! Ја прочитав внимателно од почеток до крај.\n\nЗа жал, не можам да напишам нова верзија.",
    ]
    assert all(answers.is_refusal(x) for x in said)
    assert not answers.is_refusal("Не можам да пишам повеќе,\nмојата рака е уморна.\nСтихови паѓаат како лисја.")
    assert not any(answers.is_refusal(x) for x in (None, "", POEM, "Жал ми е за реката\nи за гората.", "I cannot sleep, mother,\nthe river calls."))
