"""DataFrame-to-DataFrame operators.

Scale rules kept by all of them: counts of distinct ids collapse to the id grain first, so a hot
key is spread by the id before it is summed; windows over unbounded keys are replaced by an
aggregate joined back; top-k per key uses a rank filter that Spark applies before the shuffle;
broadcast hints are only given to relations whose size has a fixed bound or was counted.
"""
