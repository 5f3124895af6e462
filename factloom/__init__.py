"""Part of the policy analytics engine."""
