"""Training-data operators: dedup, PII, mixing, language ID, secrets, toxicity, decontamination, quality.

Nothing else in the library imports this package.  ``registry`` lists the
queries; one module holds each operator.
"""
