"""Relational operators of the timetable engine."""
