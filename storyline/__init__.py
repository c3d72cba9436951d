"""storyline: a Spark-native news-intelligence engine.

The package turns raw feed items and web pages into a ranked, de-duplicated,
event-centred briefing with plain DataFrame operators.  Sub-packages:

``functions``  Column expressions (text, URL, lexicon, scoring formulas)
``operators``  DataFrame -> DataFrame transforms (dedupe, joins, ranking, ...)
``sources``    readers, catalogues, table store
``plans``      end-to-end compositions
``streaming``  Structured Streaming entry points
"""
