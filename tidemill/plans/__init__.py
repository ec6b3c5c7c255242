"""Iterated plans: vertex programs and the algorithms written as such."""
