"""Spark-first engine for analysing long-form text and preparing it for narration."""
