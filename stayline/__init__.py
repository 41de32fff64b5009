"""Stayline: player-retention analytics as Spark DataFrame jobs."""
