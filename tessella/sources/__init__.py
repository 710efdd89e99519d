"""Readers of the tables that the engine works on."""
