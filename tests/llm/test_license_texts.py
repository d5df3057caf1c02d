"""Titles, notices and bodies of real licence files, also with words put in between."""

import pytest

from evalloom.llm import license_scan

FOUND = [
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n"),
    ("lgpl-3", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"),
    ("mit", "The MIT License (MIT)\n\nCopyright (c) 2020 A. Author"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("mpl-2", "Mozilla Public License Version 2.0\n=====\n1. Definitions"),
    ("cc-by", "Creative Commons Attribution 4.0 International Public License"),
    ("bsd", "Redistribution and use in source and compiled binary forms, in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:"),
    ("mit", "Permission is hereby granted, free of charge, hereby to any natural person obtaining a copy of this software and the associated documentation files"),
]
NONE = ["the public may license versions of this work", "license permission software copy", "GNU make, version 3", "a general notice by the foundation in june 2007", "MIT is a university"]


@pytest.mark.parametrize("filler", ["", "the of and to license software version public is this all general under a " * 3])
def test_licence_files(spark, filler):
    rows = [(i, t) for i, (_, t) in enumerate(FOUND)] + [(100 + i, t) for i, t in enumerate(NONE)] + [(1000 + i, filler) for i in range(20)]
    rows += [(200 + i, f"{filler} {t}") for i, (_, t) in enumerate(FOUND)]
    got = {r.doc_id: r.places for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(FOUND):
        for doc in (i, 200 + i):
            assert {x.label for x in got[doc] if not x.base} == {label}, (doc, got[doc])
    assert not any(got[100 + i] for i in range(len(NONE)))


def test_places_side_by_side(spark):
    got = license_scan.scan(spark.createDataFrame([(1, "All rights reserved. All rights reserved.")], "doc_id long, text string")).first()
    assert [x.word for x in got.places] == [0, 3]
