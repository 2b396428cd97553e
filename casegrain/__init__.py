"""Complaint and incident narratives as Spark jobs: mask, label, balance,
split, classify, rank similar cases, score rankings, audit."""
