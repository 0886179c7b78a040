"""Extraction of pages written and labelled by hand, and rows of all kinds."""

import time

import pytest

from lexigrain.llm import html_crf

PAGES = {
    "blog": (
        """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>On bread | Crumbs</title><link rel=stylesheet href=x.css></head><body class="home blog">
<div id="page" class="hfeed site"><header id="masthead" class="site-header" role="banner"><h1 class="site-title"><a href="/">Crumbs</a></h1><p class="site-description">Notes from a small kitchen</p></header>
<nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a><li><a href="/about">About</a><li><a href="/archive">Archive</a></ul></nav>
<div id="content" class="site-content"><main><article id="post-17" class="post hentry"><h2 class="entry-title">On bread</h2><div class="entry-content"><p>The first loaf I baked was as heavy as a brick, and about as welcome at the table.<p>Since then I have learned that time does most of the work &mdash; flour, water and salt only need to be left alone.
<ul><li>Five hundred grams of flour<li>Three hundred and fifty grams of water</ul><blockquote><p>Patience is the only secret ingredient.</p></blockquote></div></article></main>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Lovely post, thank you!</p></li><li class="comment"><p>Mine always turns out flat.</p></li></ol></div></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Soup</a></li><li><a href="/2">Salt</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly baked. &copy; 2023</div></footer></div></body></html>""",
        ["On bread", "The first loaf I baked was as heavy as a brick, and about as welcome at the table.", "Since then I have learned that time does most of the work — flour, water and salt only need to be left alone.", "Five hundred grams of flour", "Three hundred and fifty grams of water", "Patience is the only secret ingredient."],
    ),
    "news": (
        """<html><head><title>Bridge reopens</title><script>window.dataLayer=[];</script></head><body><div class="cookie-consent" role="dialog">We value your privacy. <button>Accept all</button></div>
<div class="topbar"><a href="/login">Sign in</a><a href="/sub">Subscribe</a></div><nav><a href="/world">World</a><a href="/local">Local</a><a href="/sport">Sport</a></nav>
<main id="main"><article><h1>Bridge reopens after three years of repairs</h1><p>The old bridge over the river was opened to traffic again on Monday morning.</p><div class="ad-slot"><p>Advertisement: new tyres from 49.99</p></div>
<p>Hundreds of people had gathered on both banks to watch the mayor cut the ribbon, although it rained.</p><h2>Higher costs</h2><p>According to the council the work cost <b>twice as much</b> as had been planned, because rust was found in <a href="/piers">two of the piers</a>.</p>
<div class="newsletter-signup"><h3>Get our newsletter</h3><p>The stories of the day in your inbox.</p><form><input name=e><button>Sign up</button></form></div>
<p>The footpath is to follow in spring.</p></article><section class="related"><h2>More on this</h2><ul><li><a href="/a">Ferry to stop running</a></li><li><a href="/b">Rust found in piers</a></li></ul></section></main>
<footer><p>Contact us</p><p>Terms and conditions</p></footer></body></html>""",
        ["Bridge reopens after three years of repairs", "The old bridge over the river was opened to traffic again on Monday morning.", "Hundreds of people had gathered on both banks to watch the mayor cut the ribbon, although it rained.", "Higher costs", "According to the council the work cost twice as much as had been planned, because rust was found in two of the piers.", "The footpath is to follow in spring."],
    ),
    "manual": (
        """<html><body><div class="wrapper"><div class="sidebar"><ul class="toc"><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>
<div class="document"><div class="body" role="main"><h1>Installing the tool</h1><p>Unpack the archive and run the script that is in it.</p><pre>tar xf tool.tar
./install --prefix=/usr/local</pre><p>It asks for a folder; the default is fine in most cases.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>--prefix</td><td>where files go</td></tr></table></div></div></div>
<div class="footer">Copyright 2020, the authors. Built with care.</div></body></html>""",
        ["Installing the tool", "Unpack the archive and run the script that is in it.", "tar xf tool.tar ./install --prefix=/usr/local", "It asks for a folder; the default is fine in most cases.", "Option", "Meaning", "--prefix", "where files go"],
    ),
    "plain": (
        """<html><body bgcolor=white><center><a href=index.html>index</a> | <a href=next.html>next</a></center><h1>A walk</h1><p>We set out before the sun was up and had the road to ourselves for an hour or more.
<p>Past the mill the way turns north, and one sees the hills for the first time.<hr></body></html>""",
        ["A walk", "We set out before the sun was up and had the road to ourselves for an hour or more.", "Past the mill the way turns north, and one sees the hills for the first time."],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    got = html_crf.trained().extract(source).split("\n")
    found = set(want) & set(got)
    # nothing of the text may be lost; what is not of it may be a line at most
    assert found == set(want), set(want) - found
    assert len(set(got) - set(want)) <= (1 if name == "plain" else 0), set(got) - set(want)


@pytest.mark.parametrize("source", ["<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<ul>" + "<li><ul>" * 10_000 + "<b>" * 20_000, "<td>" * 20_000, "<dt><b>" * 20_000])
def test_time_is_linear(source):
    began = time.process_time()
    html_crf.Page(source)
    assert time.process_time() - began < 3


def test_clashing_columns_and_repeated_rows(spark):
    source = PAGES["blog"][0]
    rows = [(1, "u", source, "x", 5, "y"), (1, "u", source, "x", 5, "y"), (2, None, source, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, node string")
    got = html_crf.extract_main_text(frame).collect()
    assert [r["page_id"] for r in got] == [1, 1, 2] and len({r["text"] for r in got}) == 1
    assert got[0]["text"].split("\n") == PAGES["blog"][1] and got[2]["url"] is None
    assert html_crf.extract_main_text(frame.limit(0)).count() == 0
