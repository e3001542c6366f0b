"""Coding of open-ended survey answers with Spark DataFrames.

Sub-packages:

* ``functions``  - column expressions: cleaning, redaction, prompts, reply checks
* ``sources``    - readers and writers for answers, categories and codeframes
* ``operators``  - DataFrame transforms: reshape, sample, batch, plan, code, apply
* ``plans``      - the three end-to-end jobs
* ``streaming``  - the codeframe applied to a stream of answers
"""

from themeloom.config import CodingSettings

__all__ = ["CodingSettings"]
