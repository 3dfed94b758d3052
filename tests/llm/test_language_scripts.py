"""The script of most letters of a word narrows its languages."""

import numpy as np

from tremorlake.llm import language


def test_a_paragraph_without_blanks_that_begins_with_a_brand_name_keeps_its_language():
    uses = np.zeros((len(language.SCRIPT_NAMES), 2), bool)
    uses[language.SCRIPT_NAMES.index("latin"), 0] = uses[language.SCRIPT_NAMES.index("han"), 1] = True
    model = language.Model(["en", "zh"], np.zeros((language.BUCKETS, 2)), np.zeros((language.BUCKETS, 2)), uses)
    scan = language.Scan(["Sony昨夜该岛沿海发生强烈地震数个村庄的居民离开家园 hello 12 昨夜OK了吗的"])
    best = [int(e.argmax()) if n else None for e, n in zip(model.emissions(scan), scan.letters)]
    assert [b for b in best if b is not None] == [1, 0, 1]
