"""Column functions on vectors and binary codes."""

from galena.functions.vectors import cosine, dot, hamming, l2_norm, l2_normalize, register_functions, sign_bits, valid_embedding

__all__ = ["cosine", "dot", "hamming", "l2_norm", "l2_normalize", "register_functions", "sign_bits", "valid_embedding"]
