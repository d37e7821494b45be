"""Column expressions: text cleaning, labels and small-vector math (all JVM built-ins)."""

from tonality.functions.labels import (CLASS_NAMES, class_label_index, label_code, label_majority,
                                       label_name, label_rating, sentiment_score)
from tonality.functions.text import clean_ascii, is_missing, normalize_text, run_stamp, strip_ws, words
from tonality.functions.vectors import (argmax, as_double, dot, gate, l2_norm, l2_normalize, pack_vector,
                                        relu, sigmoid, softmax, widen_vector, zeros)

__all__ = [
    "CLASS_NAMES", "argmax", "as_double", "class_label_index", "clean_ascii", "dot", "gate",
    "is_missing", "l2_norm", "l2_normalize", "label_code", "label_majority", "label_name",
    "label_rating", "normalize_text", "pack_vector", "relu", "run_stamp", "sentiment_score",
    "sigmoid", "softmax", "strip_ws", "widen_vector", "words", "zeros",
]
