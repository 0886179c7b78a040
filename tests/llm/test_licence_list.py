"""Notices of common licences, by the list the query uses."""

import pytest

from lexigrain.llm import license_scan

CASES = {
    "Copyright 2020 Somebody. All rights reserved. Other words follow": {"all-rights-reserved-bare"},
    "All rights reserved. No part of this publication may be reproduced": {"all-rights-reserved", "all-rights-reserved-bare"},
    "all the rights were reserved for us": set(),
    "under the terms of the GNU Lesser General Public License as published": {"lgpl"},
    "under the terms of the GNU Affero General Public License as published": {"agpl"},
    "under the terms of the GNU General Public License as published": set(),
    "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
    "Licensed under CC BY-SA 4.0.": {"cc-by-sa-4.0-short"},
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by-4.0"},
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": {"unlicense"},
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": {"epl-2.0"},
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.': {"bsd-disclaimer"},
    "CC0 1.0 Universal": {"cc0-1.0"},
    "Distributed under the Boost Software License, Version 1.0.": {"bsl-1.0"},
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": {"zlib"},
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    out = {k: set() for k in range(len(CASES))}
    for r in license_scan.scan_licenses(docs).collect():
        out[r["doc_id"]].add(r["license"])
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_notices(found, k):
    assert found[k] == list(CASES.values())[k]


def test_every_bare_notice_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"] for r in docs.where("lower(text) rlike 'all[^a-z0-9]+rights[^a-z0-9]+reserved'").collect()}
    got = license_scan.scan_licenses(docs).where("license = 'all-rights-reserved-bare'").collect()
    assert want and {r["doc_id"] for r in got} >= want
