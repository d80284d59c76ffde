"""Timetable analytics on Spark: legs, UTC times, connections, itineraries."""
