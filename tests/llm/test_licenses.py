import random
from difflib import SequenceMatcher

import pytest

from gazelark.llm import licenses
from gazelark.llm.licenses import TEMPLATES, Scanner, scan_licenses

S = Scanner(TEMPLATES)


@pytest.mark.parametrize("name,i", S.names)
def test_every_template_is_found_exactly(name, i):
    text = "Some words before.\n" + TEMPLATES[name][i] + "\nSome words after."
    (block,) = S.blocks(text)
    hit = S.judge(text[block[0] : block[1]])
    assert hit and hit[0] == name and hit[2] == 0 and hit[1] > 0


def test_small_changes_and_wrong_versions():
    long = TEMPLATES["MIT"][2].replace("without restriction", "with no restriction").replace("persons", "people")
    hit = S.judge(long)
    assert hit[0] == "MIT" and hit[2] == 5 and "-persons" in hit[3] and "+people" in hit[3]
    assert S.judge("Licensed under the Apache License, Version 1.1.") is None
    assert S.judge("Licensed under CC BY-NC-ND 4.0.") is None
    assert S.judge("The licence to drive a car was renewed with permission.") is None


def test_every_licence_of_a_block_is_found(spark):
    parts = [TEMPLATES[x][0] for x in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "ISC", "CC-BY-4.0", "Unlicense")]
    for n in (2, 7):
        for sep in (" ", "\n"):
            text = sep.join(parts[:n])
            (row,) = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
            want = [f"{x}:{text.index(p)}:{text.index(p) + len(p)}" for x, p in zip(("MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "ISC", "CC-BY-4.0", "Unlicense"), parts[:n], strict=False)]
            assert (row["n_blocks"], row["n_licenses"], row["n_differences"]) == (1, n, 0) and row["spans"].split(",") == want


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "İ no cue here", 0), (4, "abc def. Released under the MIT License. More text\nLicensed under CC BY-NC 4.0.", 0), (4, "abc", 0)]
    got = sorted(tuple(r)[:5] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect())
    assert got[0] == (1, 0, 0, "", "") and got[3] == (4, 0, 0, "", "")
    text = rows[3][1]
    spans = f"MIT:9:40,CC-BY-NC-4.0:{text.index('Licensed')}:{len(text)}"
    assert got[4] == (4, 2, 2, "CC-BY-NC-4.0,MIT", spans)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def exhaustive(block):
    """The licences with fewest differences of wording among all templates, without compression: (differences, names)."""
    own, found = licenses._words(block), []
    for name, texts in TEMPLATES.items():
        for template in map(licenses._words, texts):
            steps = SequenceMatcher(None, template, own, autojunk=False).get_opcodes()
            equal = [k for k, x in enumerate(steps) if x[0] == "equal"]
            if not equal:
                continue
            missing = [w for kind, a, b, _, _ in steps if kind != "equal" for w in template[a:b]]
            extra = []
            for k, (kind, a, b, c, d) in enumerate(steps):
                if kind != "equal":
                    inside = equal[0] < k < equal[-1]
                    extra += own[c:d] if inside else own[c:d][: b - a]
            if len(missing) + len(extra) <= licenses.MAX_DIFFERENT * len(template) and not any(w in licenses.TELLING or w[0].isdigit() for w in missing + extra):
                found.append((len(missing) + len(extra), name))
    least = min(found, default=(None,))[0]
    return least, {name for n, name in found if n == least}


def test_ranking_by_compression_loses_no_template_that_an_exhaustive_search_finds():
    rng = random.Random(7)
    seen = 0
    for name, i in S.names:
        words = TEMPLATES[name][i].split()
        for changes in (0, 1, 1, 2, 3):
            changed = list(words)
            for _ in range(changes):
                at = rng.randrange(len(changed))
                if rng.random() < 0.5 and len(changed) > 3:
                    del changed[at]
                else:
                    changed[at] = rng.choice(["any", "thing", "whichever"])
            block = " ".join(changed)
            hit = S.judge(block)
            least, names = exhaustive(block)
            assert (hit is None) == (least is None), block
            if hit:
                seen += 1
                assert hit[2] == least and hit[0] in names
    assert seen >= len(S.names)


def test_very_long_texts_ties_and_null_keys(spark):
    text = "word " * 400_000 + "\nReleased under the MIT License.\n" + "more " * 1000
    rows = [(None, text), (None, text), (2, "Licensed under the MIT License.\n\nLicensed under the MIT License.")]
    got = sorted(((r["doc_id"] or 0), r["n_licenses"], r["licenses"], r["n_differences"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, "MIT", 0), (0, 1, "MIT", 0), (2, 2, "MIT", 0)]
