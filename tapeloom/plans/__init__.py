"""Registered queries; importing :mod:`tapeloom.plans.all_queries` fills the registry."""
