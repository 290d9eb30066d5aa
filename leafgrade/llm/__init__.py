"""Training-data operators: classifiers, joins, tokenizers and file formats over `documents` and `pages`.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
