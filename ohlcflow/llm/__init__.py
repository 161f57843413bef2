"""Operators for preparing training data: one module per operator.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, has its own parameters, and is applied to the whole ``documents`` or
``conversations`` table by a thin ``opN_<name>`` query in ``queries``.

Rules that hold for all of them: null text counts as empty unless the module says
otherwise; repeated rows are treated one by one; columns of the input other than
those an operator names are ignored (or passed through where stated), so their
names may clash with anything; empty tables give empty results.
"""
