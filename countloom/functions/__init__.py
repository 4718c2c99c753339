from countloom.functions.special import hypergeom_tail, normal_two_sided, t_quantile, t_two_sided
from countloom.functions.ranking import benjamini_hochberg, exact_median, hash_sample, hash_shuffle_rank, tie_positions

__all__ = [
    "benjamini_hochberg", "exact_median", "hash_sample", "hash_shuffle_rank", "hypergeom_tail",
    "normal_two_sided", "t_quantile", "t_two_sided", "tie_positions",
]
