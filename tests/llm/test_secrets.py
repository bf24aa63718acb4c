"""Formats learned from labelled credentials find bare ones that no base pattern matches."""
import random
import string
import uuid

import pytest

from . import brute
from clubsieve.llm import secrets

BASE62, UPPER = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits


def credentials(rng):
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    return {
        "prefixed": lambda: "ghx_" + pick(BASE62, 36),
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "base64": lambda: pick(BASE62 + "+/", 43) + "=",
        "grouped": lambda: "-".join(pick(UPPER, 5) for _ in range(5)),
    }


def ordinary(rng):
    word = lambda a=3, b=9: "".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(a, b)))
    return rng.choice([
        lambda: "/".join(word() for _ in range(6)),
        lambda: "_".join(word(5) for _ in range(4)),
        lambda: ".".join(word(5) for _ in range(4)) + ".com",
        lambda: word(20, 30),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}/" + "-".join(word() for _ in range(4)),
        lambda: "".join(word().title() for _ in range(5)),
    ])()


def test_bare_credentials_of_learned_formats(spark):
    rng = random.Random(11)
    kinds = credentials(rng)
    rows, planted, clean, at = [], {}, set(), 0
    for _ in range(100):
        for make in kinds.values():
            rows.append((at, f'use token = "{make()}" for it'))
            rows.append((at + 1, f"then {make()} was sent"))
            planted[at + 1] = rows[-1][1].split()[1]
            rows += [(at + 2 + i, f"see {ordinary(rng)} there") for i in range(5)]
            clean |= {at + 2 + i for i in range(5)}
            at += 7
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    bare = {i for i in planted if not brute.secrets(f"then {planted[i]} was sent")}
    assert len(bare) == len(planted)  # none of them has a base pattern
    found = {i for i in bare if any(s.kind == "format" for s in out[i].spans)}
    wrong = {i for i in clean if out[i].spans}
    print("recall", len(found) / len(bare), "precision", len(found) / (len(found) + len(wrong)))
    assert len(found) >= 0.9 * len(bare)
    assert len(found) >= 0.9 * (len(found) + len(wrong))
    assert all(out[i].redacted == "then [secret] was sent" for i in found)


@pytest.mark.parametrize("kind, least", [("prefixed", 5), ("uuid", 5), ("grouped", 5)])
def test_formats_with_a_structure_keep_states_apart(kind, least):
    make = credentials(random.Random(3))[kind]
    model = secrets.infer([secrets.classes(make()) for _ in range(400)])
    assert len(model.log) >= least
    right, wrong = make(), make()[::-1].replace("-", "a").replace("_", "a")
    assert model.score(secrets.classes(right)) > model.score(secrets.classes(wrong)) + 5


def test_length_counts():
    rng = random.Random(4)
    model = secrets.infer([secrets.classes(f"{rng.getrandbits(160):040x}") for _ in range(200)])
    per_letter = lambda n: model.score(secrets.classes(f"{rng.getrandbits(4 * n):0{n}x}")) / n
    assert per_letter(40) > per_letter(39) + 0.1 and per_letter(40) > per_letter(41) + 0.1


def test_sample_is_that_of_the_whole_corpus_however_it_is_cut(spark):
    rng = random.Random(5)
    rows = [(i, f"token={rng.getrandbits(128):032x} {ordinary(rng)} x") for i in range(400)]
    frame = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string")
    picked = [sorted(map(tuple, secrets.labelled_tokens(frame.repartition(n), sample=30).collect())) for n in (1, 7)]
    assert picked[0] == picked[1] and sum(k == "assign" for k, _ in picked[0]) == 30
