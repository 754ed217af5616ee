"""The sample venues that come with the application; the sample person is the default ``nutrition.Profile``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators.ranking import MENU

VENUE = f"id string, name string, category string, cuisine string, meal_type string, average_calories double, protein_score double, health_score double, listed_match double, tags array<string>, menu {MENU}"

# Sample venues and their menus (id, name, kcal, protein, carbs, fat, fiber, tags).
VENUES = (
    ("healthy-bowl", "Healthy Bowl", "High Protein · Low Fat", "Healthy", "healthy", 540.0, 92.0, 95.0, 96.0, ["High Protein", "Low Fat", "Healthy Meal"], [
        ("chicken-protein-bowl", "Chicken Protein Bowl", 520.0, 45.0, 48.0, 14.0, 9.0, ["High Protein", "Low Fat", "Healthy"]),
        ("salmon-green-bowl", "Salmon Green Bowl", 610.0, 38.0, 42.0, 24.0, 8.0, ["Omega 3", "Healthy", "Balanced"]),
        ("tofu-fiber-bowl", "Tofu Fiber Bowl", 480.0, 28.0, 55.0, 12.0, 14.0, ["High Fiber", "Vegetarian", "Low Calorie"]),
    ]),
    ("tokyo-sushi", "Tokyo Sushi", "Sushi · Balanced Meal", "Sushi", "normal", 620.0, 78.0, 82.0, 88.0, ["Sushi", "Balanced", "Normal Meal"], [
        ("salmon-sushi-set", "Salmon Sushi Set", 620.0, 36.0, 68.0, 18.0, 4.0, ["Balanced", "Sushi", "Protein"]),
        ("tuna-rice-bowl", "Tuna Rice Bowl", 580.0, 42.0, 62.0, 12.0, 5.0, ["High Protein", "Balanced", "Seafood"]),
        ("tempura-roll-set", "Tempura Roll Set", 780.0, 25.0, 82.0, 34.0, 3.0, ["Higher Calories", "Cheat Option", "Sushi"]),
    ]),
    ("burger-house", "Burger House", "Burger · Cheat Meal", "Burger", "cheat", 880.0, 70.0, 55.0, 72.0, ["Cheat Meal", "High Calories", "Burger"], [
        ("classic-beef-burger", "Classic Beef Burger", 860.0, 38.0, 72.0, 42.0, 4.0, ["Burger", "Cheat Meal", "High Calories"]),
        ("grilled-chicken-burger", "Grilled Chicken Burger", 650.0, 44.0, 58.0, 22.0, 5.0, ["High Protein", "Better Choice", "Burger"]),
        ("double-cheese-burger", "Double Cheese Burger", 1050.0, 55.0, 76.0, 58.0, 3.0, ["High Protein", "High Calories", "Cheat Meal"]),
    ]),
)


def sample_venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VENUES), VENUE)
