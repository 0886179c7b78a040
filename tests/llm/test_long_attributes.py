"""Names late in long attributes count."""

import pytest

from lexigrain.llm import html_crf

UTILITY = "flex grid gap items center justify between bg white shadow rounded border p m w h "


@pytest.mark.parametrize("attrs", [f'class="{UTILITY}sidebar"', f'style="{"color:red;" * 400}" class="sidebar"', f'data-x="{"z" * 100_000}" id="sidebar"'])
def test_a_name_at_the_end(attrs):
    page = html_crf.Page(f"<div {attrs}>text</div>")
    assert html_crf._slot("n:sidebar") in html_crf.features(page)[1]
