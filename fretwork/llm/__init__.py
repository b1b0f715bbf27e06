"""Jobs for preparing training text: each module is one operator over whole tables."""
