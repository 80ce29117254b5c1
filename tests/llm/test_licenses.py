import random
import re

from samples import MESSY, documents

from staygrid.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


NEEDED = {"mit": {"mit"}, "agpl": {"affero"}, "lgpl": {"lesser"}, "cc-by-sa": {"sharealike"}, "apache": {"apache"}}
BARRED = {"gpl": {"affero", "lesser"}, "agpl": {"lesser"}, "lgpl": {"affero"}, "cc-by": {"sharealike"}}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_scan(text, notices, phrases, containment):
    words = WORD.findall(lowered(text))
    places, base, labels, best = [], set(), set(), 0.0
    for phrase, label in phrases.items():
        own = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(own)] == own:
                places.append(k)
                base.add(label)
                best = 1.0
    longest = max(len(WORD.findall(lowered(t))) for t in [*phrases, *(t for _, t in notices)])
    for start in range(0, max(1, len(words)), longest):
        block = set(words[start : start + 2 * longest])
        for label, notice in notices:
            own = set(WORD.findall(lowered(notice)))
            share = len(own & block) / len(own)
            needed = NEEDED.get(label, set()) & own
            if share >= containment - 1e-12 and needed <= block and not BARRED.get(label, set()) & block:
                labels.add(label)
                best = max(best, share)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
        "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)), "score": best,
    }


def compare(spark, rows, notices=licenses.TEMPLATES, phrases=licenses.BASE, containment=licenses.CONTAINMENT):
    got = [
        {k: v for k, v in r.asDict().items() if k != "blocks"}
        for r in licenses.scan(documents(spark, rows), notices, phrases, containment).collect()
    ]
    want = [{"doc_id": d, **plain_scan(t, notices, phrases, containment)} for d, t in rows]
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_notices_whole_broken_and_shuffled(spark):
    turn = random.Random(2)
    rows = list(MESSY)
    for k in range(60):
        words = ["".join(turn.choices("abcdefgh", k=4)) for _ in range(turn.randint(0, 300))]
        for _ in range(turn.randint(0, 3)):
            notice = turn.choice([t for _, t in licenses.TEMPLATES] + list(licenses.BASE)).split()
            for _ in range(turn.randint(0, 4)):
                notice[turn.randrange(len(notice))] = "zzz"
            if turn.random() < 0.3:
                turn.shuffle(notice)
            at = turn.randint(0, len(words))
            words[at:at] = notice
        rows.append((100 + k, turn.choice((" ", "\n", " * ")).join(words)))
    got = compare(spark, rows)
    assert sum(r["n_base"] for r in got) > 5
    assert {"bsd", "mpl", "cc-by-sa"} & {x for r in got for x in r["labels"].split(",")}


def test_phrases_need_their_words_in_line(spark):
    rows = [
        (1, "MIT License mit license, MIT\nLicense"), (2, "license mit"), (3, "the mit open license"),
        (4, "CC-BY CC BY ccby"), (5, "gnu general public public license"), (6, "İMIT License ÄMIT LICENSE"),
        (7, "apache license " * 400), (8, "GNU General Public License" + " x" * 200 + " gnu general public license"),
    ]
    got = {r["doc_id"]: r for r in compare(spark, rows)}
    assert got[1]["n_base"] == 3 and got[7]["n_base"] == 400 and got[8]["last_word"] == 204
    assert got[2]["base_labels"] == got[3]["base_labels"] == ""


def test_small_alphabet_and_every_threshold(spark):
    turn = random.Random(5)
    notices = [(f"l{k}", " ".join(turn.choices("abcdefghij", k=turn.randint(1, 9)))) for k in range(30)]
    rows = [(k, " ".join(turn.choices("abcdefghijklmnopqrst", k=turn.randint(0, 40)))) for k in range(80)]
    for containment in (0.3, 0.5, 2 / 3, 0.8, 1.0):
        compare(spark, rows, notices, {"a b": "ab", "c": "c"}, containment)


def test_no_rows(spark):
    assert licenses.scan(documents(spark, [])).collect() == []


def test_templates_do_not_give_each_others_labels():
    templates = licenses.templates_from(licenses.TEMPLATES, licenses.BASE)
    index = licenses.Index(templates, {}, licenses.CONTAINMENT)
    for label, text in licenses.TEMPLATES:
        assert set(licenses.scan_text(f"Some words before. {text} And after.", index)["labels"].split(",")) == {label}
    for text in ("released under the license", "This file is released under the Apache License, see there"):
        assert "mit" not in licenses.scan_text(text, index)["labels"].split(",")
